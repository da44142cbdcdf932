"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every source keeps the documents whose hash lies below a threshold. The thresholds come from histograms: sizes are summed by
source and hash bucket, the bucket in which a source's budget ends is found, and only that bucket is summed again by the next
bits of the hash. No documents are sorted, and no step reads more than one row for each source and bucket in a task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # times its size that a source, and so a document, can be taken
BITS, LEVELS = 12, 5  # of the 60-bit hash: buckets of a level, and levels until a bucket is one hash value


def doc_hash(doc_id: Column, seed: str) -> Column:
    """60 bits that depend on the id alone, so that reruns and copies of a row agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size), one row for each source.

    Shares are level * weight, capped at ``most`` times the size; the level is where all shares meet the total. With sources
    by rising cap per weight, capping the first i leaves the others (total - their caps) / (their weights), which rises while
    the next source is still above its cap and falls afterwards: the level is the largest of these.
    """
    name = F.col("source").asc_nulls_last()
    n = (F.row_number().over(Window.orderBy(name)) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("long")
    every = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy((F.col("cap") / F.col("weight")), name).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total, all_weights = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = every.withColumn("each", level).withColumn("level", F.max("each").over(whole))
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def times(h: Column) -> Column:
    """How often a document with hash ``h`` is taken, given its source's row of ``thresholds``."""
    more = (h < F.col("t.edge")) | ((h == F.col("t.edge")) & (F.col("t.left") * 2 > F.col("t.s")))
    return F.col("t.full") + F.coalesce(more, F.lit(False)).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), source_key().alias("k"), doc_hash(F.col("doc_id"), seed).alias("h"))


def thresholds(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str, slim: DataFrame | None = None) -> DataFrame:
    """One row for each source key k: source_size, target, full (whole copies), edge (the hash where the rest of the budget ends),
    left (what is left of it there) and s (the size that lies on the edge)."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save("slim", sized(docs, seed).select("source", "size", "k", "h")) if slim is None else slim
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.select(source_key().alias("k"), "source_size", "target", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("edge"))
    state = scratch.save("level-0", state)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        here = slim.filter("size > 0").join(state.select("k", "edge"), "k")
        here = here.filter(F.shiftright("h", shift + BITS) == F.col("edge")) if level else here
        sums = here.groupBy("k", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("s"))
        upto = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        over = upto.join(state.select("k", "left"), "k").filter(F.col("upto") > F.col("left"))
        end = over.groupBy("k").agg(F.min(F.struct("cell", "s", "upto")).alias("e")).select("k", F.col("e.cell").alias("cell"), F.col("e.s").alias("s"), F.col("e.upto").alias("upto"))
        left = F.coalesce(F.col("left") - (F.col("upto") - F.col("s")), "left")
        state = state.drop("s").join(end, "k", "left").select("k", "source_size", "target", "full", left.alias("left"), F.coalesce("cell", F.lit(0)).alias("edge"), "s")
        state = scratch.save(f"level-{level + 1}", state)
        scratch.drop(f"level-{level}")
    return state


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, one row for each row of ``docs``.

    A source is taken whole floor(target / size) times, and once more for the documents below its hash threshold; the
    document on the threshold is added where that brings the source nearer to its target. So a source misses its target by
    half a document at most (rows that share an id share their hash and count as one). Null and empty texts have size 0 and are
    taken as 0 words; a null source is a source of its own, after all others; a null doc_id has a hash like any value. No
    rows give no rows. Other columns are not read.
    """
    slim = Scratch(docs.sparkSession, "mixed").save("slim", sized(docs, seed))
    out = slim.alias("d").join(thresholds(docs, weights, most, seed, slim).alias("t"), "k").withColumn("copies", times(F.col("d.h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS each
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(each) OVER () * weight) AS target FROM l),
f AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS s
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= rest OR 2 * (rest - (upto - s)) > s THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` with all columns, each row as often as ``mixed`` takes its document. The decision is a function of source and
    hash, so the texts are not moved: each row meets its source's thresholds. Columns can have any names; nulls are as in ``mixed``."""
    state = thresholds(docs, weights, most, seed)
    k, h, n = (fresh(docs, name) for name in ("mix_key", "mix_hash", "mix_copy"))
    columns = [F.col("d.`" + c.replace("`", "``") + "`") for c in docs.columns]
    keyed = docs.withColumns({k: source_key(), h: doc_hash(F.col("doc_id"), seed)})
    both = keyed.alias("d").join(state.select(F.col("k").alias(k), "full", "edge", "left", "s").alias("t"), k)
    copies = times(F.col(f"d.{h}"))
    return both.filter(copies > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*columns)
