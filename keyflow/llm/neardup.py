"""Near-duplicate documents: circulant MinHash candidates, exact Jaccard links, connected components.

Signatures come from two permutations of the bins of a fixed universe: the first scatters the shingles, the second is
read at every circular shift, one shift for each coordinate. Equal bands of coordinates make candidates; every link is
confirmed on the full shingle sets.

Copies never multiply: documents with equal sets are one node from the start. Within a bucket of equal bands, members
are compared with one hub first, so a group of any size gives as many pairs as it has members; links join members to
components. Members that are still in different components are described by their differences from what most of their
group has: small differences prove links with one centre, and the others can only link where they share a difference.
That loses no link that could change a component.
"""

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import Scratch, fresh, release, small_batches

BINS = 1 << 20
BANDS, ROWS = 32, 5  # at a similarity of 0.85, 7 links in 10**9 are in no common bucket; at 0.8, 3 in 10**6
SHIFTS = BANDS * ROWS
#: A pair whose estimated similarity is this far below the threshold (over six standard deviations) is not verified.
SLACK = 0.2

_permutations: list[np.ndarray] = []


def permutations() -> tuple[np.uint64, np.ndarray]:
    """The first permutation's odd multiplier, and the second one unrolled so that each shift is a slice of it."""
    if not _permutations:
        second = np.random.default_rng(20).permutation(BINS).astype(np.uint32)
        _permutations.append(np.concatenate([second, second[:SHIFTS]]))
    return np.uint64(0x2545F491), _permutations[0]


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Circulant MinHash of consecutive non-empty sets, which start at ``at``: one row of SHIFTS values for each."""
    odd, second = permutations()
    bins = (((hashes >> np.uint64(44)) * odd + np.uint64(0x51ED)) & np.uint64(BINS - 1)).astype(np.int64)
    out = np.empty((len(at), SHIFTS), np.uint32)
    for k in range(SHIFTS):
        out[:, k] = np.minimum.reduceat(second[k : k + BINS].take(bins), at)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        total = tk.mix((total ^ rows[:, :, j]) * np.uint64(0x9E3779B97F4A7C15))
    return total.view(np.int64)


def shingle_sets(column, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of documents: the first one's number, and the sorted distinct shingle hashes of each."""
    for a, b, words, at in tk.hashed_words(column):
        yield a, [np.unique(tk.shingle_hashes(words[at[i] : at[i + 1]], width)) for i in range(b - a)]


def describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, sets in shingle_sets(batch.column(1), width):
            counts = np.array([len(s) for s in sets])
            full = np.flatnonzero(counts)
            halves = digest_halves([sets[i] for i in full])
            hashes = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
            sig = signatures(hashes, np.concatenate([[0], np.cumsum(counts[full])[:-1]]).astype(np.int64)) if len(full) else np.zeros((0, SHIFTS), np.uint32)
            low = sig.astype(np.uint16)
            place = np.full(len(sets), -1)
            place[full] = np.arange(len(full))
            pick = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, len(sets)),
                    pa.array(counts, pa.int64()),
                    pa.array(halves[:, 0]).take(pick),
                    pa.array(halves[:, 1]).take(pick),
                    pa.array([x.tobytes() for x in low], pa.binary()).take(pick),
                    pa.ListArray.from_arrays(np.arange(0, len(full) * BANDS + 1, BANDS, dtype=np.int32), band_hashes(sig).ravel()).take(pick),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "signature", "bands"],
            )


def digest_halves(sets: list[np.ndarray]) -> np.ndarray:
    """The two halves of a digest of each set."""
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, sets in shingle_sets(batch.column(1), width):
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            halves = digest_halves(sets)
            columns = [batch.column(0).slice(a, len(sets)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(ends, values)]
            yield pa.RecordBatch.from_arrays(columns, ["low", "d1", "d2", "shingles"])


def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates of two signatures."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), SHIFTS)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), SHIFTS)
    return pd.Series((x == y).mean(axis=1))


#: Rows of up to four numbers (32 MB) that are broadcast, so that texts stay where they are; more are joined by a shuffle.
FEW_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A table of ids, marked for broadcast if a count shows that it is small."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest node that can be reached over the links (a, b).

    In a round each node goes to the first of itself and its neighbours, and what the links become between those is the next
    round's graph: it has the same components, and a component ends as one node without links. First is the smallest in round 0,
    which takes groups around a hub, and the least hash later, another one in each round, so that about half of the nodes
    are left in any order of the ids: a chain takes rounds by the log of its length. A round joins only the links that are left; at
    the end the moves are followed backwards.
    """
    edges = scratch.save(f"{name}-edges-0", links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    moves: list[DataFrame] = []
    for turn in count():
        release(scratch.spark)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.col(c)).alias("h"), F.col(c).alias("v")) for c in ("a", "b"))
        best = both.groupBy("a").agg(F.min(other).alias("best"))
        move = scratch.save(f"{name}-move-{turn}", best.select(F.col("a").alias("node"), F.least("best", own)["v"].alias("to")))
        moves.append(move)
        one = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        edges = scratch.save(f"{name}-edges-{turn + 1}", two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(f"{name}-edges-{turn}")
        if edges.isEmpty():
            break
    scratch.drop(f"{name}-edges-{turn + 1}")
    labels = moves[-1].select("node", F.col("to").alias("label"))
    for turn in reversed(range(len(moves) - 1)):
        further = labels.select(F.col("node").alias("to"), "label")
        labels = scratch.save(f"{name}-{turn}", moves[turn].join(further, "to", "left").select("node", F.coalesce("label", "to").alias("label")))
        scratch.drop(f"{name}-move-{turn + 1}", f"{name}-{turn + 1}")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = scratch.save(name, labels.join(least, "label").select("node", F.col("least").alias("label")))
    scratch.drop(f"{name}-move-0", f"{name}-0")
    return out


def same_document(base: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links between the nodes of ids that have several texts, from each to the first one."""
    key = F.struct("d1", "d2")
    some = base.filter("d1 is not null and doc_id is not null").select("doc_id", "d1", "d2")
    several = some.groupBy("doc_id").agg(F.min(key).alias("one"), F.max(key).alias("two")).filter("one <> two").select("doc_id", "one")
    pairs = some.join(several, "doc_id").filter(key != F.col("one")).select("d1", "d2", F.col("one.d1").alias("e1"), F.col("one.d2").alias("e2")).distinct()
    pairs = scratch.save("same", pairs)
    first = nodes.select(F.col("node").alias("a"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    return pairs.join(nodes.select(F.col("node").alias("b"), "d1", "d2"), ["d1", "d2"]).join(first, ["e1", "e2"]).select("a", "b")


def differences(sets: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, n, grp, diff, u, centre (u, node) of ``nodes`` (node, n, grp).

    ``diff`` are the shingles in which a set differs from those that more than half of its group has, whichever side lacks
    them. Two sets x and y of n shingles are linked exactly if u(x) + u(y) <= 2 * (100 + percent) * (number of common differences),
    where u = (100 + percent) * size(diff) - (100 - percent) * n. ``centre`` has the group's least u.
    """
    here = scratch.save("group-sets", sets.join(nodes, "node").select("node", "n", "grp", "shingles"))
    count_ = here.select("grp", F.explode("shingles").alias("s")).groupBy("grp", "s").agg(F.count("*").alias("f")).filter("f > 1")
    usual = count_.join(nodes.groupBy("grp").agg(F.count("*").alias("of")), "grp").filter("2 * f > of").groupBy("grp").agg(F.collect_list("s").alias("usual"))
    found = here.join(usual, "grp", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>")))
    found = found.select("node", "n", "grp", F.concat(F.array_except("shingles", "usual"), F.array_except("usual", "shingles")).alias("diff"))
    found = scratch.save("diffs", found.withColumn("u", F.size("diff").cast("long") * (100 + percent) - F.col("n") * (100 - percent)))
    return found.join(found.groupBy("grp").agg(F.min(F.struct("u", "node")).alias("centre")), "grp")


def prefix_pairs(diffs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: pairs of ``diffs`` (see ``differences``; and label) with different labels that can be linked, a superset of those links that
    the centre doesn't make.

    Each set's differences are ordered by rising frequency in the group. Linked sets share one in the prefixes that are left
    when the least number of common ones is taken away, and at the first shared one enough must follow in both. So differences
    that few sets share come first, and a large group of texts with many edits each doesn't meet all pairs.
    """
    twice = 2 * (100 + percent)
    each = diffs.select("node", "n", "grp", "label", "u", F.col("centre.u").alias("u0"), F.size("diff").alias("d"), F.explode("diff").alias("s"))
    mixed = each.groupBy("grp", "s").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("grp", "s", "f")
    order = each.join(mixed, ["grp", "s"]).groupBy("node", "n", "grp", "label", "u", "u0", "d").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("shared"))
    order = order.withColumn("own", F.col("d") - F.size("shared"))  # what no other label has comes first
    prefix = F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("u0")) / twice)) + 1 - F.col("own")
    order = order.withColumn("shared", F.slice("shared", 1, F.greatest(prefix, F.lit(0)).cast("int")))
    at = order.select("node", "n", "grp", "label", "u", "d", "own", F.posexplode("shared").alias("i", "e"))
    at = scratch.save("rest-prefix", at.select("node", "n", "grp", "label", "u", (F.col("d") - F.col("own") - F.col("i")).alias("left"), F.col("e.s").alias("s")))
    one = at.select("grp", "s", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "label", "u", "left")))
    two = at.select("grp", "s", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "u", "left")))
    fits = f"node1 < node2 and label1 <> label2 and least(n1, n2) * 100 >= greatest(n1, n2) * {int(percent)} and {twice} * least(left1, left2) >= u1 + u2"
    return one.join(two, ["grp", "s"]).filter(fits).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of ``docs``.

    Two documents are linked when their sets of distinct ``width``-word shingles (ASCII lower case) have a Jaccard
    similarity of ``percent``/100 or more; ``component_id`` is the smallest doc_id that links reach, ``kept`` says whether it
    is the document's own. A text with fewer words than ``width`` is one shingle. Texts without words (null, empty,
    white space) have no set and link with nothing. Repeated rows of one id and text agree. Rows of one id with different texts are one
    document: what links with any of them is in its component, though each row has the size of its own text. A null doc_id
    links with nothing: its component is null and the row is kept. A very long text is one set like any other. No rows give no
    rows. Ids are read as 64-bit integers; columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = docs.mapInArrow(lambda it: describe(it, width), "doc_id long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>")
    base = scratch.save("base", base)
    # A node is a set of shingles; low: the smallest document that has it.
    nodes = base.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = scratch.save("nodes", nodes.withColumn("node", F.monotonically_increasing_id()))
    links = same_document(base, nodes, scratch)

    # Buckets with two members or more; m: member, hub: its bucket's smallest one.
    in_band = nodes.select(F.explode("bands").alias("band"), F.col("node").alias("m"))
    shared = scratch.save("shared", in_band.groupBy("band").agg(F.min("m").alias("hub"), F.max("m").alias("last")).filter("hub < last").select("band", "hub"))
    members = scratch.save("members", in_band.join(shared, "band").join(nodes.select(F.col("node").alias("m"), "n"), "m").select("band", "hub", "m", "n"))

    wanted = members.select(F.col("m").alias("node")).distinct().join(nodes, "node").select("node", "low", "d1", "d2")
    wanted = few(scratch.save("wanted", wanted))
    sets = docs.select(F.col("doc_id").alias("low"), "text").join(wanted, "low", "left_semi")
    sets = sets.mapInArrow(lambda it: sets_of(it, width), "low long, d1 long, d2 long, shingles array<long>")
    sets = scratch.save("sets", sets.join(wanted, ["low", "d1", "d2"]).select("node", "shingles").dropDuplicates(["node"]))
    slim = nodes.select("node", "n", "signature")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """a, b, linked of the candidate pairs whose sizes and signatures allow a link."""
        left = slim.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("signature").alias("ax"))
        right = slim.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("signature").alias("bx"))
        sized = pairs.join(left, "a").join(right, "b").filter(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
        likely = sized.filter(F.pandas_udf(likeness, "double")("ax", "bx") >= percent / 100 - SLACK).select("a", "b", "an", "bn")
        full = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return scratch.save(name, full.select("a", "b", (common * 100 >= (F.col("an") + F.col("bn") - common) * percent).alias("linked")))

    seen, labels, diffs = None, None, None
    for turn in ("hub", "centre", "rest"):
        release(docs.sparkSession)
        if turn == "hub":
            pairs = members.filter("hub < m").select(F.col("hub").alias("a"), F.col("m").alias("b")).distinct()
        else:
            if turn == "centre":
                # Buckets whose members are still in more than one component; a group: what such buckets connect.
                here = members.join(labels.withColumnRenamed("node", "m"), "m", "left").withColumn("label", F.coalesce("label", "m"))
                open_ = here.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("m").alias("first")).filter("low < high")
                here = scratch.save("open", here.select("band", "m", "n").join(open_.select("band", "first"), "band"))
                groups = connected(here.filter("first < m").select(F.col("first").alias("a"), F.col("m").alias("b")), scratch, "groups")
                some = scratch.save("grouped", here.select(F.col("m").alias("node"), "n").distinct().join(groups.withColumnRenamed("label", "grp"), "node"))
                release(docs.sparkSession)
                diffs = differences(sets, some, percent, scratch)
            here = diffs.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            if turn == "centre":
                middle = here.filter("node = centre.node").select("grp", F.col("label").alias("middle"))
                pairs = here.filter("u + centre.u <= 0").join(middle, "grp").filter("label <> middle")
                pairs = pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b"))
            else:
                pairs = prefix_pairs(here, percent, scratch)
            pairs = pairs.distinct().join(seen, ["a", "b"], "left_anti")
        found = verified(pairs, turn)
        seen = pairs.select("a", "b") if seen is None else seen.union(pairs.select("a", "b"))
        new = found.filter("linked").select("a", "b")
        links = links.union(new)
        if labels is None or not new.isEmpty():
            labels = connected(links, scratch, f"labels-{turn}")
    low = labels.join(nodes.select("node", "low"), "node").groupBy("label").agg(F.min("low").alias("component"))
    of_node = nodes.select("d1", "d2", "node", "low").join(labels.join(low, "label").select("node", "component"), "node", "left")
    of_node = scratch.save("components", of_node.select("d1", "d2", F.coalesce("component", "low").alias("component")))
    scratch.drop("nodes", "same", "shared", "members", "wanted", "sets", "open", "grouped", "group-sets", "diffs", "rest-prefix", "hub", "centre", "rest")
    out = base.select("doc_id", "n_shingles", "d1", "d2").join(of_node, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns, of each component of near duplicates only the document with the smallest id.

    Rows that repeat a kept id stay, as do rows without an id and texts without words. Only the ids of what goes are joined. Columns
    can have any names.
    """
    gone = near_duplicates(docs, width, percent).filter("not kept").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession, "gone").save("ids", gone)
    name = fresh(docs, "gone")
    return docs.join(few(gone.withColumnRenamed("doc_id", name)), F.col("doc_id").cast("long") == F.col(name), "left_anti")
