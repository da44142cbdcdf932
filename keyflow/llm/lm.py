"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation, scores whole texts.

Tokens are ASCII-lower-cased words, and an end after each text. Every token belongs to a unit: the most frequent tokens are units of
their own, tokens that training has once or never are one unit, and each of the others shares one with the tokens whose hashes are
near. How many units there are grows with the input.
The representation of the next token is bilinear in those of the units of the two tokens before it. It is matched, by
matrices over the distinct contexts of a batch, with the representations of the most frequent units and of groups of the others,
and then with those of the units of the token's group: two normalised choices. Within a shared unit a token has its share of the
training counts; in the unit of rare tokens all unknown words together have a discount of the others' counts.

1. All words are counted, by batches and buckets (census.py), and every batch gets the counts of its words.
2. Each batch trains on all its training tokens, from the same start; the models are averaged by tokens, in a tree.
3. Batches read their texts and counts again and score.

Batches depend on ids and sizes alone, and rows are sorted in them, so scores don't depend on how the input is partitioned.
The parameters and a few totals reach the driver; their size grows with the square root of the input's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from . import tokens as tk
from .scratch import Scratch

FREQUENT = 256  # units that are in no group
GROUPS = 256  # of the other units
OWN = 512  # times the square root of the number of batches: so many tokens at most have units of their own, and so many units are shared
WIDE = 24  # numbers of a representation
NOISE = 64  # noise choices among frequent units and groups of a step, and within their groups of each token
NEAR_NOISE = 4
STEP = 4096  # tokens of a step
BLOCK = 256  # contexts that are normalised at once
ROWS = 4096  # that are gathered at once
NARROW = 1024  # and those of a step that stay near in memory while they are worked on
ROOM = 32 << 20  # bytes of the exponentials of a part of the choices
LOUD = 1e10  # exponentials up to here have exact enough products
RATE = 0.08
END = np.uint64(0x5851F42D4C957F2D)  # the end's place among word hashes
FOLDS, HELD = 7, 2
BINS = 256  # of counts, four for each doubling

COUNTED = "batch int, bucket int, kind int, counts binary, tops array<struct<word: long, n: long, bin: int>>, shared array<struct<unit: int, n: long>>, total long, distinct long, once long, twice long"


def held_out(ids: list) -> np.ndarray:
    """Documents that training leaves out, by the CRC-32 of the id's digits (of nothing for a null)."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids], bool)


def token_stream(column) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of consecutive texts, ends included, and the texts' offsets into them."""
    hashes, sizes = [], []
    for _, _, words, at in tk.hashed_words(column):
        hashes.append(np.insert(words, at[1:], END))
        sizes.append(np.diff(at) + 1)
    sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def distinct_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, and the place of each number among them; only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[coded.indices.to_numpy()]


def ask(table: pa.Table, buckets: int) -> pa.Table:
    """A batch's distinct tokens with their training counts."""
    tokens, at = token_stream(table.column("text"))
    train = np.repeat(~held_out(table.column("doc_id").to_pylist()), np.diff(at))
    keys, which = distinct_of(tokens)
    counts = np.bincount(which, train, len(keys)).astype(np.int64)
    return census.ask(table.column("batch")[0].as_py(), keys, np.zeros(0, np.uint64), counts, buckets)


def own_units(batches: int) -> int:
    """How many tokens can have units of their own beside the FREQUENT, and how many units the others share."""
    return int(OWN * batches**0.5)


def bin_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum((4 * np.log2(np.maximum(counts, 1))).astype(np.int64), BINS - 1)


def shared_unit(keys: np.ndarray, units: int) -> np.ndarray:
    """The unit that a token shares, by ranges of the hash."""
    return ((keys >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)


def count(table: pa.Table, units: int) -> pa.Table:
    """To each batch of a bucket, its tokens' counts over all batches, in the order asked; and of the bucket the totals, those of the
    shared units, and the tokens that can have units of their own."""
    keys, _, vals, _ = census.unpack(table)
    distinct, which = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, vals)
    got = total[which]
    sizes = [len(x) // 8 for x in table.column("keys").to_pylist()]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n, bucket = table.num_rows, table.column("bucket")[0].as_py()
    often = total > 1
    top = np.lexsort((distinct, -total))[: FREQUENT + units]
    tops = [{"word": int(w), "n": int(c), "bin": int(b)} for w, c, b in zip(distinct[top].view(np.int64), total[top], bin_of(total[top]), strict=True) if c > 1]
    some, at = np.unique(shared_unit(distinct[often], units), return_inverse=True)
    shared = [{"unit": u, "n": int(m)} for u, m in zip(some.tolist(), np.bincount(at, total[often].astype(float), len(some)), strict=True)]
    rows = {
        "batch": [*table.column("batch").to_pylist(), -1],
        "bucket": [bucket] * (n + 1),
        "kind": [0] * n + [1],
        "counts": [*(got[edges[i] : edges[i + 1]].tobytes() for i in range(n)), None],
        "tops": [None] * n + [tops],
        "shared": [None] * n + [shared],
        "total": [None] * n + [int(total.sum())],
        "distinct": [None] * n + [int((total > 0).sum())],
        "once": [None] * n + [int((total == 1).sum())],
        "twice": [None] * n + [int((total == 2).sum())],
    }
    word = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("bin", pa.int32())]))
    unit_kind = pa.list_(pa.struct([("unit", pa.int32()), ("n", pa.int64())]))
    kinds_of = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), word, unit_kind, *[pa.int64()] * 4]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), kinds_of, strict=True)})


def alias(chance: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables for draws from each group of places between two edges, whose chances add up to 1: a place that is drawn evenly is
    kept with a chance, else the other one is taken."""
    keep, other = np.ones(len(chance)), np.arange(len(chance))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        left = (chance[a:b] * (b - a)).tolist()
        small, large = [i for i, x in enumerate(left) if x < 1], [i for i, x in enumerate(left) if x >= 1]
        while small and large:
            i, j = small.pop(), large[-1]
            keep[a + i], other[a + i] = left[i], a + j
            left[j] -= 1 - left[i]
            if left[j] < 1:
                small.append(large.pop())
    return keep.astype(np.float32), other


@dataclass
class Counts:
    """What all batches share of the corpus. Units are numbered: that of rare and unknown tokens, the frequent ones, the other tokens
    with units of their own, the shared ones. The groups of units that aren't frequent are the remainders of their numbers."""

    words: np.ndarray  # tokens with units of their own, in ascending order
    unit: np.ndarray  # and these units
    frequent: int  # units that are in no group
    mass: np.ndarray  # of each unit, the training tokens that are in it
    shared: int  # units that are shared
    tokens: int
    distinct: int
    discount: float  # the unknown words' share of the first unit

    def __post_init__(self):
        near = np.arange(self.frequent, self.units)
        self.order = near[np.argsort(near % GROUPS, kind="stable")]  # units by group
        self.edges = np.searchsorted(self.order % GROUPS, np.arange(GROUPS + 1))
        self.sizes = np.diff(self.edges)
        place = np.zeros(self.units, np.int64)
        place[self.order] = np.arange(len(self.order))
        self.place = place
        weight = self.mass + 0.5
        groups = np.bincount(near % GROUPS, weight[near], GROUPS)
        chance = np.concatenate([weight[: self.frequent], groups])
        self.chance = chance / chance.sum()
        self.within = weight[self.order] / groups[self.order % GROUPS]  # of each unit in its group, in their order
        self.keep, self.other = alias(self.within, self.edges)
        self.log_noise = np.log(NOISE * self.chance).astype(np.float32)
        self.log_near = np.log(NEAR_NOISE * self.within).astype(np.float32)

    @property
    def units(self) -> int:
        return len(self.mass)

    @property
    def choices(self) -> int:
        return self.frequent + GROUPS

    def unit_of(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The units of tokens with their training counts."""
        rest = self.units - self.shared + shared_unit(tokens, self.shared)
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
            rest = np.where(self.words[place] == tokens, self.unit[place], rest)
        return np.where(counts > 1, rest, 0)

    def share(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The chance of each token in its unit, or of all unknown words."""
        mass = np.maximum(self.mass[units], 1)
        known = np.where(units > 0, counts / mass, (1 - self.discount) / mass)
        return np.where(counts > 0, known, self.discount)

    def choice_of(self, units: np.ndarray) -> np.ndarray:
        return np.where(units < self.frequent, units, self.frequent + units % GROUPS)


def totals(counted: DataFrame, units: int) -> Counts:
    own = counted.filter("kind = 1")
    total, distinct, once, twice = (int(v or 0) for v in own.agg(F.sum("total"), F.sum("distinct"), F.sum("once"), F.sum("twice")).first())
    # The least bin of counts such that all tokens from there on have units of their own.
    tops = own.select(F.explode("tops").alias("t")).select("t.*")
    sizes = dict(tops.groupBy("bin").count().collect())
    least, n = BINS, 0
    for b in sorted(sizes, reverse=True):
        n += sizes[b]
        if n > FREQUENT + units:
            break
        least = b
    top = sorted(tops.filter(F.col("bin") >= least).select("word", "n").collect(), key=lambda r: (-r.n, r.word))
    shared = dict(own.select(F.explode("shared").alias("s")).groupBy("s.unit").agg(F.sum("s.n")).collect())
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    n_words = np.array([r.n for r in top], np.int64)
    mass = np.array([shared.get(u, 0) for u in range(units)], np.int64)
    np.subtract.at(mass, shared_unit(words, units), n_words)
    order = np.argsort(words)
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 1.0
    return Counts(words[order], order.astype(np.int64) + 1, 1 + min(FREQUENT, len(words)), np.concatenate([[once], n_words, mass]), units, total, distinct, discount)


def in_turn(index: np.ndarray) -> np.ndarray:
    """The order that sorts numbers and keeps equal ones as they are; numbers of 16 bits are dealt by digits, which is faster."""
    return np.argsort(index.astype(np.uint16) if len(index) and index.max() < 1 << 16 else index, kind="stable")


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of small numbers in ascending order, and the place of each number among them."""
    some = np.flatnonzero(np.bincount(values))
    place = np.zeros(some[-1] + 1 if len(some) else 0, np.int64)
    place[some] = np.arange(len(some))
    return some, place[values]


def sums_by(place: np.ndarray, columns: Iterable[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sums of the rows at each place; rows and sums are given by columns."""
    sums = np.zeros(shape, np.float32)
    for into, column in zip(sums, columns, strict=True):
        np.add.at(into, place, column)
    return sums


def logistic(half: np.ndarray) -> np.ndarray:
    """The chance that a choice is none of the noise, by half its negative score, whose place it takes."""
    np.tanh(half, out=half)
    half *= np.float32(-0.5)
    half += np.float32(0.5)
    return half


class Model:
    """Parameters, the biases as last columns of targets: representations of units as contexts (the last one: before a text), of
    the frequent units and groups as targets, of the other units as targets, and a matrix for each context place. Untrained, it gives
    the counts' shares."""

    def __init__(self, counts: Counts):
        rng = np.random.default_rng(2)
        by_counts = lambda chance: np.column_stack([np.zeros((len(chance), WIDE)), np.log(chance)]).astype(np.float32)
        self.context = rng.normal(0, 0.1, (counts.units + 1, WIDE)).astype(np.float32)
        self.target = by_counts(counts.chance)
        self.near = by_counts(counts.within)  # in the order of groups
        self.place = np.stack([np.eye(WIDE), 0.5 * np.eye(WIDE)]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.near, self.place]

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float16).tobytes()

    def load(self, data: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = data[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What contexts make of the next token's representation, and 1 for its bias."""
        h = np.ones((len(one), WIDE + 1), np.float32)
        by_one, by_two = self.context @ self.place[0], self.context @ self.place[1]
        for a in range(0, len(one), ROWS):
            part = slice(a, a + ROWS)
            np.add(by_one.take(one[part], 0), by_two.take(two[part], 0), out=h[part, :WIDE])
        return h

    def norms(self, one: np.ndarray, two: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Logarithms of the sums of all choices' exponentials after contexts, which come in the order of ``one``.

        A choice's score is the sum of what each place of the context gives, so its exponential is the product of theirs, and a context's sum is
        a product of two vectors. Sums that are out of range, or have factors that are, are found again from the scores.
        """
        (ones, of_one), (twos, of_two) = ranked(one), ranked(two)
        loud = np.zeros(len(ones), bool), np.zeros(len(twos), bool)
        cuts = np.union1d(np.flatnonzero(np.diff(of_one, prepend=-1)), np.arange(0, len(one), BLOCK)).tolist() + [len(one)]
        total = np.zeros(len(one), np.float32)
        by_one, by_two = self.context[ones] @ self.place[0], self.context[twos] @ self.place[1]
        rows = of_one[cuts[:-1]]
        edges = np.searchsorted(rows, np.arange(0, len(ones) + BLOCK, BLOCK)).tolist()
        rows = (rows % BLOCK).tolist()
        wide = max(1, ROOM // (4 * (BLOCK + len(twos))))
        with np.errstate(over="ignore", invalid="ignore"):
            for j in range(0, len(self.target), wide):
                target = self.target[j : j + wide]
                right = by_two @ target[:, :WIDE].T
                np.exp(right, out=right)
                loud[1][:] |= right.max(1) > LOUD
                room = np.empty((BLOCK, len(target)), np.float32)
                for k, c, d in zip(range(0, len(ones), BLOCK), edges[:-1], edges[1:]):
                    left = by_one[k : k + BLOCK] @ target[:, :WIDE].T
                    left += target[:, WIDE]
                    np.exp(left, out=left)
                    loud[0][k : k + BLOCK] |= left.max(1) > LOUD
                    for a, b, row in zip(cuts[c:d], cuts[c + 1 : d + 1], rows[c:d], strict=True):
                        total[a:b] += np.take(right, of_two[a:b], 0, room[: b - a], "clip") @ left[row]
            bad = np.flatnonzero(loud[0][of_one] | loud[1][of_two] | ~(total > 1 / LOUD))
        out = np.log(np.maximum(total, 1 / LOUD))
        for a in range(0, len(bad), BLOCK):
            scores = h[bad[a : a + BLOCK]] @ self.target.T
            top = scores.max(1)
            out[bad[a : a + BLOCK]] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return out

    def step(self, j: int, squares: list[np.ndarray], some: np.ndarray, sums: np.ndarray, size: int) -> None:
        """Adagrad on the rows of a part that a step has met; squares are never near 0."""
        part = self.parts()[j]
        for a in range(0, len(some), NARROW):
            rows = some[a : a + NARROW]
            g = np.divide(sums[a : a + NARROW], np.float32(size), order="C")
            s = squares[j].take(rows, 0)
            root = g * g
            s += root
            squares[j][rows] = s
            g /= np.sqrt(s, out=root)
            g *= np.float32(RATE)
            part[rows] = np.subtract(part.take(rows, 0, out=s, mode="clip"), g, out=s)

    def train(self, units: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, counts: Counts, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """A step on tokens and their two predecessors: tell each choice from shared noise choices, and each unit from noise units of
        its group, as if scores were normalised."""
        size = len(units)
        # Products with the places' matrices are taken once for each distinct unit of the contexts.
        met, at = ranked(np.concatenate([one, two]))
        one, two = at[:size], at[size:]
        x = self.context.take(met, 0)
        wide = np.ones((size, WIDE + 1), np.float32)
        np.add((x @ self.place[0]).take(one, 0), (x @ self.place[1]).take(two, 0), out=wide[:, :WIDE])
        log_noise, log_near = counts.log_noise, counts.log_near
        chosen = counts.choice_of(units)
        q, z = self.target.take(chosen, 0), self.target.take(noise, 0)
        up = -logistic(0.5 * (np.einsum("ij,ij->i", wide, q) - log_noise[chosen]))
        against = -0.5 * z
        against[:, WIDE] += 0.5 * log_noise[noise]
        by_columns = np.ascontiguousarray(wide.T)
        q *= up[:, None]
        to_h, noisy = q, np.zeros((WIDE + 1, len(noise)), np.float32)
        for a in range(0, size, NARROW):
            part = slice(a, a + NARROW)
            down = logistic(wide[part] @ against.T)
            to_h[part] += down @ z
            noisy += by_columns[:, part] @ down
        far = np.flatnonzero(chosen >= counts.frequent)
        if len(far):
            at = counts.place[units[far]]
            group = chosen[far] - counts.frequent
            of = counts.sizes[group]
            drawn = rng.random((len(far), NEAR_NOISE), np.float32) * of[:, None].astype(np.float32)
            even = np.minimum(drawn.astype(np.int64), of[:, None] - 1)
            drawn -= even
            even += counts.edges[group][:, None]
            drawn = np.where(drawn < counts.keep[even], even, counts.other[even])
            near = np.concatenate([at[:, None], drawn], axis=1)  # each unit and its noise
            w, z = wide.take(far, 0), self.near.take(near, 0)
            pull = np.einsum("ij,ikj->ik", w, z)
            pull -= log_near[near]
            pull[:, 0] *= 0.5
            pull[:, 1:] *= -0.5
            pull = logistic(pull)
            pull[:, 0] *= -1
            to_h[far] += np.einsum("ik,ikj->ij", pull, z)
            # The sums of a place of the representation are taken while its numbers are at hand.
            pull = np.ascontiguousarray(pull.T)
            some, at = ranked(near.T.ravel())
            sums = sums_by(at, ((pull * column).ravel() for column in by_columns.take(far, 1)), (WIDE + 1, len(some)))
            self.step(2, squares, some, sums.T, size)
        some, at = ranked(np.concatenate([chosen, noise]))
        sums = sums_by(at, (np.concatenate([up * column, more]) for column, more in zip(by_columns, noisy, strict=True)), (WIDE + 1, len(some)))
        self.step(1, squares, some, sums.T, size)
        by_columns = np.ascontiguousarray(to_h[:, :WIDE].T)
        first, second = (sums_by(at, by_columns, (WIDE, len(met))) for at in (one, two))
        grad = np.stack([first @ x, second @ x]).transpose(0, 2, 1) / size
        self.step(0, squares, met, first.T @ self.place[0].T + second.T @ self.place[1].T, size)
        squares[3] += grad * grad
        self.place -= RATE * grad / np.sqrt(squares[3] + 1e-8)

    def log_chance(self, units: np.ndarray, one: np.ndarray, two: np.ndarray, counts: Counts) -> np.ndarray:
        """Normalised log probabilities of units after their contexts; each distinct unit of a context is taken once, whatever their order."""
        order = in_turn(units)
        for key in (two, one):
            order = order[in_turn(key[order])]
        units, one, two = units[order], one[order], two[order]
        starts = (np.diff(one, prepend=-1) != 0) | (np.diff(two, prepend=-1) != 0)  # of contexts
        first = np.flatnonzero(starts)
        taken = np.flatnonzero(starts | (np.diff(units, prepend=-1) != 0))
        times = np.diff(taken, append=len(units))
        units, which = units[taken], np.cumsum(starts)[taken] - 1
        h = self.hidden(one[first], two[first])
        norm = self.norms(one[first], two[first], h)
        ones = np.ones(np.diff(counts.edges).max(), np.float32)
        widest = np.sqrt(np.einsum("ij,ij->i", h, h))
        chosen = counts.choice_of(units)
        out = np.empty(len(units), np.float64)
        for a in range(0, len(units), ROWS):
            part = slice(a, a + ROWS)
            out[part] = np.einsum("ij,ij->i", h.take(which[part], 0), self.target.take(chosen[part], 0)) - norm[which[part]]
        by_group = in_turn(chosen)
        edges = np.searchsorted(chosen[by_group], counts.frequent + np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b = counts.edges[g], counts.edges[g + 1]
            longest = np.sqrt((self.near[a:b] ** 2).sum(1).max(initial=0))
            for c in range(edges[g], edges[g + 1], 4096):
                some = by_group[c : min(c + 4096, edges[g + 1])]
                place = which[some]
                scores = h.take(place, 0) @ self.near[a:b].T
                own = scores[np.arange(len(some)), counts.place[units[some]] - a]
                if widest[place].max() * longest > 60:
                    top = scores.max(1)
                    scores -= top[:, None]
                    own -= top
                out[some] += own - np.log(np.exp(scores, out=scores) @ ones[: b - a])
        back = np.empty(len(order))
        back[order] = np.repeat(out, times)
        return back


def contexts(units: np.ndarray, at: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of the token before each and of the one before that; ``before`` where the text has none."""
    one, two = np.full(len(units), before), np.full(len(units), before)
    one[1:] = units[:-1]
    two[2:] = units[:-2]
    first = at[:-1][np.diff(at) > 0]
    one[first] = before
    two[first] = before
    second = first[np.diff(at)[np.diff(at) > 0] > 1] + 1
    two[second] = before
    return one, two


NO_MODEL = pa.table({"part": pa.array([], pa.int32()), "seen": pa.array([], pa.int64()), "model": pa.array([], pa.binary())})
KIND = "part int, seen long, model binary"


def in_order(table: pa.Table) -> pa.Table:
    """A batch's rows by id and text, however they came."""
    digest = pa.array([zlib.crc32((t or "").encode()) for t in table.column("text").to_pylist()], pa.int64())
    return table.append_column("digest", digest).sort_by([("doc_id", "ascending"), ("digest", "ascending")])


def counted_tokens(docs: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct tokens and their training counts, which of them the tokens are, and the texts' offsets into these."""
    answers = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    in_turn = np.frombuffer(b"".join(r["counts"] for r in answers), np.int64)  # buckets ascend as keys do
    tokens, at = token_stream(docs.column("text"))
    keys, which = distinct_of(tokens)
    if len(keys) != len(in_turn):
        raise ValueError("the counts of a batch are not complete")
    return keys, in_turn, which, at


def train_batch(docs: pa.Table, answers: pa.Table, counts: Counts) -> pa.Table:
    part = docs.column("batch")[0].as_py()
    model, seen = Model(counts), 0
    squares = [np.full_like(p, 1e-4) for p in model.parts()]
    rng = np.random.default_rng(part)
    docs = in_order(docs)
    keys, c, which, at = counted_tokens(docs, answers)
    units = counts.unit_of(keys, c)[which]
    one, two = contexts(units, at, counts.units)
    learnt = np.repeat(~held_out(docs.column("doc_id").to_pylist()), np.diff(at))
    units, one, two = units[learnt], one[learnt], two[learnt]
    for a in range(0, len(units), 64 * STEP):
        order = a + rng.permutation(min(64 * STEP, len(units) - a))
        for b in range(0, len(order), STEP):
            some = order[b : b + STEP]
            noise = rng.choice(counts.choices, NOISE, p=counts.chance)
            model.train(units[some], one[some], two[some], noise, counts, rng, squares)
    seen = len(units)
    return pa.table({"part": pa.array([part] * (seen > 0), pa.int32()), "seen": pa.array([seen] * (seen > 0), pa.int64()), "model": pa.array([model.dump()] * (seen > 0), pa.binary())})


def average(table: pa.Table) -> pa.Table:
    """The mean of a group's models, weighted by the tokens that each has seen."""
    table = table.sort_by("part")
    seen = table.column("seen").to_numpy()
    total: np.ndarray | None = None
    for n, raw in zip(seen.tolist(), table.column("model"), strict=True):
        part = np.frombuffer(raw.as_py(), np.float16).astype(np.float64) * (n / seen.sum())
        total = part if total is None else total + part
    return pa.table({"part": table.column("group").cast(pa.int32())[:1], "seen": pa.array([int(seen.sum())], pa.int64()), "model": pa.array([total.astype(np.float16).tobytes()], pa.binary())})


def train(dealt: DataFrame, answers: DataFrame, counts: Counts, batches: int) -> Model:
    """Every training token once; the batches' models are averaged in a tree, 16 at a time."""
    models = census.joined(dealt, answers, lambda d, a: train_batch(d, a, counts) if d.num_rows else NO_MODEL, KIND)
    while True:
        models = models.withColumn("group", F.floor(F.col("part") / 16)).groupBy("group").applyInArrow(average, KIND)
        batches = -(-batches // 16)
        if batches <= 1:
            break
    row = models.first()
    return Model(counts) if row is None else Model(counts).load(np.frombuffer(row.model, np.float16).astype(np.float32))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_batch(docs: pa.Table, answers: pa.Table, counts: Counts, model: Model) -> pa.Table:
    keys, c, which, at = counted_tokens(docs, answers)
    own = counts.unit_of(keys, c)
    units = own[which]
    one, two = contexts(units, at, counts.units)
    log = model.log_chance(units, one, two, counts)
    log += np.log(counts.share(own, c))[which]
    base = np.log10((c + 1) / (counts.tokens + counts.distinct + 1))[which]
    first = at[:-1]
    sums = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: E731  # every text has an end
    n = docs.num_rows
    out = {
        "doc_id": docs.column("doc_id"),
        "held_out": pa.array(held_out(docs.column("doc_id").to_pylist())),
        "n_tokens": pa.array(np.diff(at)),
        "n_known": pa.array(sums((c > 0)[which].astype(np.int64))),
        "train_tokens": pa.array(np.full(n, counts.tokens)),
        "base_score": pa.array(sums(base)),
        "score": pa.array(sums(log) / np.log(10)),
    }
    return pa.table(out)


NONE = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})


def score(docs: DataFrame, batch_bytes: int = census.BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text), a row for each
    row of ``docs``.

    The model learns from the documents that aren't held out. A null or empty text is its end alone. Repeated rows count as often
    as they are there, and have equal scores; a null doc_id is not held out. No rows give no rows; if all are held out, all
    words are unknown. A very long text is a batch of its own. Tokens of equal count have units of their own together or
    not at all. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    dealt, n = census.batched(docs, batch_bytes)
    buckets, units = census.buckets_for(n), own_units(n)
    asked = census.grouped(dealt, "batch", lambda t: ask(t, buckets), census.ASKED)
    counted = scratch.save("counts", census.grouped(asked, "bucket", lambda t: count(t, units), COUNTED))
    counts = totals(counted, units)
    answers = counted.filter("kind = 0").select("batch", "bucket", "counts")
    model = train(dealt, answers, counts, n)
    return census.joined(dealt, answers, lambda d, a: score_batch(d, a, counts, model) if d.num_rows else NONE, SCORED)
