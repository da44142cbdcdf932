"""Quality classifier by co-training: one view is a page's text, the other its metadata.

Each view has a logistic model. Over rounds, each scores all unlabelled documents and labels the share that it is most sure of
for the other's training set. Both are then calibrated on held-out labels and combined; the combination scores every document.

Only the labelled rows are a bounded sample (``labelled``), which the driver holds. Of the other documents executors count scores
and words, and add up gradients and Hessians; those sums, whose size is fixed, reach the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .scratch import Scratch, release, small_batches

SHAPE = 14  # numbers that describe a text's form
SLOTS = 64  # of hashed metadata values
SHARE = 0.025  # of all documents, that a view labels for the other in each class: so much in the first round, twice more in the second, ...
SURE = 295  # the least bin of a pseudo-label: a probability of 0.95
BASE, HELD = 1, 2  # parts of the labelled rows; 0 is any other document


def text_features(column) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Blocks of texts: the first one's number, the distinct word hashes (32 bits) of each (letters and digits, lower case), and the form numbers."""
    data, offsets = tk.text_bytes(column)
    for a, b in tk.blocks(offsets):
        raw = data[offsets[a] : offsets[b]]
        low = tk.LOWER[raw]
        within = offsets[a : b + 1] - offsets[a]
        starts, ends, at = tk.word_spans(low, within, tk.SYMBOLS)
        words = tk.span_hashes(low, starts, ends)
        _, _, tokens_at = tk.word_spans(low, within, tk.WHITE)
        counts = np.zeros((b - a, 6))
        ascii_ = raw < 128
        kinds = ((raw >= 65) & (raw < 91), (raw >= 48) & (raw < 58), tk.SYMBOLS[low] & ~tk.WHITE[raw] & ascii_, np.isin(raw, np.frombuffer(b"!#$%&*|@~^", np.uint8)), raw == 10, ~ascii_)
        for j, kind in enumerate(kinds):
            total = np.concatenate([[0], np.cumsum(kind)])
            counts[:, j] = total[within[1:]] - total[within[:-1]]
        form = np.zeros((b - a, SHAPE))
        sets = []
        for i in range(b - a):
            mine = words[at[i] : at[i + 1]]
            distinct = np.unique((mine >> np.uint64(32)).astype(np.uint32))
            sets.append(distinct)
            size, n = max(1, within[i + 1] - within[i]), max(1, len(mine))
            pairs = np.unique(mine[:-1] * np.uint64(3) + mine[1:]) if len(mine) > 1 else mine
            same = np.count_nonzero(mine[1:] == mine[:-1])
            form[i, :6] = counts[i] / size
            form[i, 6:] = (
                np.log1p(len(mine)) / 5,
                np.log1p(size) / 8,
                len(distinct) / n,
                len(pairs) / n,
                same / n,
                min(4.0, size / n / 8),
                (tokens_at[i + 1] - tokens_at[i]) / n - 1,
                len(mine) < 5,
            )
        yield a, sets, form


def meta_features(langs: list, sources: list, sizes: list) -> np.ndarray:
    """Slots of hashed language and source, and the document's stated length; nulls are values of their own."""
    out = np.zeros((len(langs), 2 * SLOTS + 3))
    for at, values in ((0, langs), (SLOTS, sources)):
        column = pa.array([None if v is None else f"{v}" for v in values], pa.string()).fill_null("\x00null")
        data, offsets = tk.text_bytes(column)
        slot = tk.span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(SLOTS)
        out[np.arange(len(values)), at + slot.astype(np.int64)] = 1
    length = np.array([-1 if v is None else max(0, v) for v in sizes], float)
    out[:, -3] = np.log1p(np.maximum(length, 0)) / 8
    out[:, -2] = out[:, -3] ** 2
    out[:, -1] = length < 0
    return out


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, without a penalty; a block of rows at a time."""
    grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for at in range(0, len(x), 2000):
        part = slice(at, at + 2000)
        rows = np.column_stack([x[part], np.ones(len(x[part]))]).astype(float)
        p = squash(rows @ w)
        grad += rows.T @ (weight[part] * (p - y[part]))
        hess += rows.T @ (rows * (weight[part] * np.maximum(p * (1 - p), 1e-6))[:, None])
    return grad, hess


def newton(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The next coefficients, and the longest move."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    move = np.linalg.solve(hess + np.diag(penalty), grad + penalty * w)
    most = np.abs(move).max()
    return w - move * min(1.0, 5 / max(1e-9, most)), most


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients with the intercept last; the features are dense and few."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(30):
        w, most = newton(w, *slopes(x, y, weight, w), ridge)
        if most < 1e-4:
            break
    return w


@dataclass
class TextModel:
    """Presence of chosen words, and form numbers."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    form: np.ndarray = field(default_factory=lambda: np.zeros(SHAPE + 1))

    def score(self, sets: list[np.ndarray], form: np.ndarray) -> np.ndarray:
        out = form @ self.form[:-1] + self.form[-1]
        if len(self.words):
            for at in range(0, len(sets), 500):
                part = sets[at : at + 500]
                every = np.concatenate([*part, np.zeros(0, np.uint32)])
                place = np.minimum(np.searchsorted(self.words, every), len(self.words) - 1)
                total = np.concatenate([[0], np.cumsum(np.where(self.words[place] == every, self.weights[place], 0))])
                edges = np.concatenate([[0], np.cumsum([len(s) for s in part])]).astype(np.int64)
                out[at : at + 500] += total[edges[1:]] - total[edges[:-1]]
        return out


def codes_of(words: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, the numbers of those of ``words`` (ascending) that it has."""
    return [np.flatnonzero(np.isin(words, s, assume_unique=True)).astype(np.uint16) for s in sets]


def text_matrix(form: np.ndarray, codes: list[np.ndarray], n: int) -> np.ndarray:
    x = np.zeros((len(form), SHAPE + n), np.float32)
    x[:, :SHAPE] = form
    x[np.repeat(np.arange(len(codes)), [len(c) for c in codes]), SHAPE + np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64)] = 1
    return x


@dataclass
class Classifier:
    text: TextModel
    meta: np.ndarray
    combine: np.ndarray  # of the text view's score, the metadata view's score, and 1
    calibrate_text: np.ndarray
    calibrate_meta: np.ndarray
    trained: int
    pseudo: tuple[int, int]  # labels that the text view gave and that the metadata view gave

    def scores(self, column, langs, sources, sizes) -> np.ndarray:
        """Columns: probability by text, by metadata, and by both."""
        out = []
        for a, sets, form in text_features(column):
            b = a + len(sets)
            t = self.text.score(sets, form)
            m = meta_features(langs[a:b], sources[a:b], sizes[a:b]) @ self.meta[:-1] + self.meta[-1]
            both = np.column_stack([t, m, np.ones(len(t))]) @ self.combine
            out.append(np.column_stack([squash(t * self.calibrate_text[0] + self.calibrate_text[1]), squash(m * self.calibrate_meta[0] + self.calibrate_meta[1]), squash(both)]))
        return np.concatenate([*out, np.zeros((0, 3))])


def featured(batches: Iterator[pa.RecordBatch], ids: np.ndarray, good: np.ndarray, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Features of all rows; those of the sample of labels (ascending ids) have part BASE or HELD and a class."""
    for batch in batches:
        doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(ids, doc), max(0, len(ids) - 1))
        known = (ids[place] == doc) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(doc), bool)
        split = np.where(known, np.where(held[place], HELD, BASE), 0) if len(ids) else np.zeros(len(doc), int)
        label = pa.array(good[place] if len(ids) else np.zeros(len(doc), int), pa.int32(), mask=~known)
        for a, sets, form in text_features(batch.column("text")):
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, n), pa.array(split[a : a + n], pa.int32()), label.slice(a, n), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([f.tobytes() for f in form], pa.binary()), *(batch.column(c).slice(a, n) for c in ("lang", "source", "n_chars"))],
                ["doc_id", "split", "good", "words", "form", "lang", "source", "n_chars"],
            )


def unpacked(batch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word sets, form numbers and metadata features of featured rows."""
    sets = [np.frombuffer(x, np.uint32) for x in batch.column("words").to_pylist()]
    form = np.frombuffer(b"".join(batch.column("form").to_pylist()), float).reshape(-1, SHAPE)
    return sets, form, meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


@dataclass
class Round:
    """Both views' models and calibrations, and for each view the bins up to which it says bad and from which it says good."""

    text: TextModel
    meta: np.ndarray
    calibrate: tuple[np.ndarray, np.ndarray]
    cuts: tuple[tuple[int, int], tuple[int, int]] = ((-1 << 30, 1 << 30), (-1 << 30, 1 << 30))

    def bins(self, sets: list[np.ndarray], form: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Hundredths of the calibrated log odds, by text and by metadata."""
        raw = self.text.score(sets, form), meta @ self.meta[:-1] + self.meta[-1]
        return [np.floor(np.clip(r * c[0] + c[1], -30, 30) * 100).astype(np.int64) for r, c in zip(raw, self.calibrate, strict=True)]

    def labels(self, *features) -> list[np.ndarray]:
        """What each view says of rows: 1, 0, or -1 where it isn't sure enough."""
        return [np.where(b >= high, 1, np.where(b <= low, 0, -1)) for b, (low, high) in zip(self.bins(*features), self.cuts, strict=True)]


def count_bins(batches: Iterator[pa.RecordBatch], now: Round) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for view, bins in enumerate(now.bins(*unpacked(batch))):
            values, n = np.unique(bins, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), view), pa.int32()), pa.array(values), pa.array(n.astype(np.int64))], ["view", "bin", "n"])


def cut(bins: np.ndarray, n: np.ndarray, least: float) -> tuple[int, int]:
    """The lowest bin, from SURE up, that takes ``least`` rows with those above it or all there are; and how many rows that takes."""
    order = np.argsort(-bins)
    order = order[bins[order] >= SURE]
    if not len(order):
        return 1 << 30, 0
    upto = np.cumsum(n[order])
    at = min(int(np.searchsorted(upto, least)), len(order) - 1)
    return int(bins[order[at]]), int(upto[at])


def count_words(batches: Iterator[pa.RecordBatch], now: Round | None) -> Iterator[pa.RecordBatch]:
    """Words of the text view's training rows by class, in tenths of a row: ten for a label, three for a pseudo-label."""
    for batch in batches:
        split, good = batch.column("split").to_numpy(), batch.column("good").fill_null(-1).to_numpy()
        sets, form, meta = unpacked(batch)
        said = now.labels(sets, form, meta)[1] if now else np.full(len(sets), -1)
        label = np.where(split == BASE, good, np.where(split == HELD, -1, said))
        use = np.flatnonzero(label >= 0)
        every = np.concatenate([*(sets[i] for i in use), np.zeros(0, np.uint32)])
        words, which = np.unique(every, return_inverse=True)
        each = [len(sets[i]) for i in use]
        tenths, y = np.repeat(np.where(split[use] == BASE, 10, 3), each), np.repeat(label[use], each)
        tally = [np.bincount(which, tenths * (y == c), len(words)).astype(np.int64) for c in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(tally[0]), pa.array(tally[1])], ["word", "good", "bad"])


def choose_words(rows: DataFrame, now: Round | None, good: float, bad: float, most_words: int = 600) -> np.ndarray:
    """Words are chosen by the log-likelihood ratio of their presence in the two classes, which have ``good`` and ``bad`` rows."""
    tally = rows.mapInArrow(lambda it: count_words(it, now), "word long, good long, bad long").groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tally = tally.filter("good + bad >= 40").select("word", (F.col("good") / 10).alias("g"), (F.col("bad") / 10).alias("b"))
    share = good / max(1e-9, good + bad)
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("g") + F.col("b")) * max(1e-12, s)))).otherwise(0.0)
    best = tally.withColumn("gain", part("g", share) + part("b", 1 - share)).filter("gain > 6").orderBy(F.desc("gain"), "word").limit(most_words)
    return np.array(sorted(r.word for r in best.select("word").collect()), np.uint32)


def taught(batches: Iterator[pa.RecordBatch], now: Round, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with a pseudo-label: that for the text view, that for the metadata view, and small features."""
    for batch in batches:
        sets, form, meta = unpacked(batch)
        by_text, by_meta = now.labels(sets, form, meta)
        use = np.flatnonzero((by_text >= 0) | (by_meta >= 0))
        codes = codes_of(words, [sets[i] for i in use])
        rest = [batch.column(c).take(pa.array(use)) for c in ("form", "lang", "source", "n_chars")]
        yield pa.RecordBatch.from_arrays([pa.array(by_meta[use], pa.int32()), pa.array(by_text[use], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), *rest], ["to_text", "to_meta", "codes", "form", "lang", "source", "n_chars"])


def sum_slopes(batches: Iterator[pa.RecordBatch], text: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = [np.zeros(s) for n in (len(text), len(meta)) for s in (n, n * n)]
    for batch in batches:
        form = np.frombuffer(b"".join(batch.column("form").to_pylist()), float).reshape(-1, SHAPE)
        x = text_matrix(form, [np.frombuffer(c, np.uint16) for c in batch.column("codes").to_pylist()], len(text) - SHAPE - 1)
        z = meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        for k, (rows, name, w) in enumerate(((x, "to_text", text), (z, "to_meta", meta))):
            y = batch.column(name).to_numpy()
            for t, more in zip(total[2 * k :], slopes(rows[y >= 0], y[y >= 0], np.ones(np.sum(y >= 0)), w), strict=False):
                t += more.ravel()
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(total).tobytes()], pa.binary())], ["part", "sums"])


def add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), float) for x in table.column("sums"))
    return pa.table({"part": table.column("group").cast(pa.int32())[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def all_slopes(rows: DataFrame, text: np.ndarray, meta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian of either view over all pseudo-labels, added up in a tree."""
    kind = "part int, sums binary"
    sums = rows.mapInArrow(lambda it: sum_slopes(it, text, meta), kind)
    for fan in (16, 16, 1 << 30):
        sums = sums.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group").applyInArrow(add_up, kind)
    row = sums.first()
    n, m = len(text), len(meta)
    flat = np.zeros(n + n * n + m + m * m) if row is None else np.frombuffer(row.sums, float)
    at = n + n * n
    return [(flat[:n], flat[n:at].reshape(n, n)), (flat[at : at + m], flat[at + m :].reshape(m, m))]


def keyed(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(docs: DataFrame, labels: DataFrame, labelled: int = 12_000, rounds: int = 3) -> Classifier | None:
    """Fits both views. ``labelled`` bounds (in expectation) the labels that are used, which are drawn by a hash of doc_id; of the
    other documents none is left out. None where the labels have only one class. A label is good with quality 1 and not toxic; rows
    with a null doc_id or quality are left out; of several labels of a document the worst counts."""
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    sample = known.filter(keyed("labelled") < labelled / max(1, known.count())).toPandas().sort_values("doc_id")
    ids, good = sample.doc_id.to_numpy(np.int64), sample.good.to_numpy(np.int64)
    if len(set(good.tolist())) < 2:
        return None
    held = np.arange(len(ids)) % 5 == 4  # ids say nothing of the class
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    schema = "doc_id long, split int, good int, words binary, form binary, lang string, source string, n_chars long"
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save("rows", slim.mapInArrow(lambda it: featured(it, ids, good, held), schema))
    model = co_train(rows, scratch, rounds)
    scratch.close()
    release(docs.sparkSession)
    return model


def co_train(rows: DataFrame, scratch: Scratch, rounds: int) -> Classifier | None:
    own = rows.filter("split > 0").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    sets, form, meta = unpacked(own)
    y, held = own.column("good").to_numpy().astype(float), own.column("split").to_numpy() == HELD
    del own
    base = np.flatnonzero(~held)
    if min(np.sum(y[base] == 1), np.sum(y[base] == 0), np.sum(y[held] == 1), np.sum(y[held] == 0)) < 1:
        return None
    pool = rows.filter("split = 0")
    n_pool = pool.count()
    even, one = np.ones(len(base)), np.ones(held.sum())
    now: Round | None = None
    pseudo = [(0, 0), (0, 0)]  # bad and good ones by text, and by metadata
    for turn in range(rounds + 1):
        release(scratch.spark)
        words = choose_words(rows, now, np.sum(y[base] == 1) + 0.3 * pseudo[1][1], np.sum(y[base] == 0) + 0.3 * pseudo[1][0])
        x = text_matrix(form[base], codes_of(words, [sets[i] for i in base]), len(words))
        w = [fit_logistic(x, y[base], even, 0.3), fit_logistic(meta[base], y[base], even, 3.0)]
        if now and sum(map(sum, pseudo)):
            taught_rows = scratch.save(f"taught-{turn}", pool.mapInArrow(lambda it, now=now, words=words: taught(it, now, words), "to_text int, to_meta int, codes binary, form binary, lang string, source string, n_chars long"))
            # Together, pseudo-labels weigh 0.3 of the labels at most, however many there are.
            weight = [0.3 * min(1.0, len(base) / max(1, sum(pseudo[view]))) for view in (1, 0)]
            for _ in range(30):
                far = all_slopes(taught_rows, *w)
                near = [slopes(f, y[base], even, v) for f, v in zip((x, meta[base]), w, strict=True)]
                w, moves = zip(*(newton(v, a[0] + k * b[0], a[1] + k * b[1], ridge) for v, a, b, k, ridge in zip(w, near, far, weight, (0.3, 3.0), strict=True)), strict=True)
                if max(moves) < 1e-2:
                    break
            scratch.drop(f"taught-{turn}")
        text, coefs = TextModel(words, w[0][SHAPE:-1], np.concatenate([w[0][:SHAPE], w[0][-1:]])), w[1]
        t, m = text.score([sets[i] for i in np.flatnonzero(held)], form[held]), meta[held] @ coefs[:-1] + coefs[-1]
        cal = fit_logistic(t[:, None], y[held], one, 1e-3), fit_logistic(m[:, None], y[held], one, 1e-3)
        if turn < rounds:
            now = Round(text, coefs, cal)
            tally = pool.mapInArrow(lambda it, now=now: count_bins(it, now), "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()
            least = SHARE * (turn + 1) * (turn + 2) / 2 * n_pool
            cuts = []
            for view in (0, 1):
                bins, n = (tally[tally.view == view][c].to_numpy(np.int64) for c in ("bin", "n"))
                (high, n_good), (low, n_bad) = cut(bins, n, least), cut(-bins - 1, n, least)
                cuts.append((-low - 1, high))
                pseudo[view] = n_bad, n_good
            now.cuts = tuple(cuts)
    combine = fit_logistic(np.column_stack([t, m]), y[held], one, 1e-2)
    return Classifier(text, coefs, combine, *cal, len(base), (sum(pseudo[0]), sum(pseudo[1])))


def _scored(batches: Iterator[pa.RecordBatch], model: Classifier | None, keep_only: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        texts, rest = batch.column(batch.schema.get_field_index("text")), [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars")]
        s = model.scores(texts, *rest) if model else np.full((n, 3), np.nan)
        if keep_only is not None:
            yield batch.filter(pa.array(~(s[:, 2] < keep_only)))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(s[:, j], mask=np.isnan(s[:, j])) for j in range(3))], ["doc_id", "text_score", "meta_score", "score"])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """doc_id, text_score, meta_score, score (probabilities of a good document), kept: one row for each row of ``docs``.

    Null and empty texts are scored by their form and metadata; null metadata are values of their own. Without two classes
    of labels (an empty table, say) scores are null and all is kept. Equal rows have equal scores. Other columns are not read.
    """
    model = train(docs, labels, **bounds)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    out = slim.mapInArrow(lambda it: _scored(it, model, None), "doc_id long, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.coalesce(F.col("score") >= threshold, F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    model = train(docs, labels, **bounds)
    return docs.mapInArrow(lambda it: _scored(it, model, threshold), docs.schema)
