import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from keyflow.llm.lm import Counts, Model, own_units, score

from .util import clashing, corpus, docs, words


@pytest.mark.parametrize("batch", [3_000, 1 << 23])
def test_counts_and_base_scores(spark, batch):
    rows = corpus(7)
    got = score(clashing(docs(spark, rows)), batch).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = sorted(((i, held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == expected
    assert all(r.score < 0 for r in got)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    out = score(spark.read.parquet(path)).filter("held_out").collect()
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)


def small_counts(shared=300):
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    unit = rng.permutation(700) + 1
    mass = np.concatenate([[50], rng.integers(2, 90, 700), rng.integers(0, 30, shared)])
    return Counts(words, unit, 257, mass, shared, int(mass.sum()), 2000, 0.4)


def test_chances_sum_to_one():
    counts = small_counts()
    model = Model(counts)
    rng = np.random.default_rng(1)
    for part in model.parts():
        part += rng.normal(0, 0.5, part.shape).astype(np.float32)
    units = np.arange(counts.units)
    for one, two in ((0, 5), (700, counts.units), (counts.units, counts.units)):
        log = model.log_chance(units, np.full(len(units), one), np.full(len(units), two), counts)
        assert abs(np.exp(log).sum() - 1) < 1e-4


def test_untrained_models_give_the_shares_of_counts():
    counts = small_counts()
    units = np.arange(counts.units)
    log = Model(counts).log_chance(units, units, units, counts)
    assert np.allclose(np.exp(log), (counts.mass + 0.5) / (counts.mass + 0.5).sum(), rtol=1e-3)


def test_log_chance_against_single_tokens():
    counts = small_counts()
    model = Model(counts)
    rng = np.random.default_rng(2)
    for part in model.parts():
        part += rng.normal(0, 0.3, part.shape).astype(np.float32)
    units, one, two = (rng.integers(0, counts.units, 200) for _ in range(3))
    got = model.log_chance(units, one, two, counts)
    for i, (u, a, b) in enumerate(zip(units.tolist(), one.tolist(), two.tolist(), strict=True)):
        h = np.append(model.context[a] @ model.place[0] + model.context[b] @ model.place[1], 1)
        scores = np.exp((model.target @ h).astype(float))
        choice = u if u < 257 else 257 + u % 256
        want = math.log(scores[choice] / scores.sum())
        if u >= 257:
            peers = [x for x in range(257, counts.units) if x % 256 == u % 256]
            near = {x: math.exp(float(model.near[counts.place[x]] @ h)) for x in peers}
            want += math.log(near[u] / sum(near.values()))
        assert abs(got[i] - want) < 1e-3


def test_units_and_shares():
    counts = small_counts()
    some = counts.words[::7]
    assert (counts.unit_of(some, np.full(len(some), 5)) == counts.unit[::7]).all()
    others = np.random.default_rng(3).integers(0, 1 << 63, 50).astype(np.uint64)
    assert (counts.unit_of(others, np.full(50, 3)) >= 701).all()
    for few in (0, 1):
        assert (counts.unit_of(some, np.full(len(some), few)) == 0).all()
    assert math.isclose(50 * counts.share(np.zeros(1, int), np.ones(1))[0] + counts.share(np.zeros(1, int), np.zeros(1))[0], 1)


def test_training_learns_which_word_follows():
    """Also among units of groups, which outnumber the frequent ones."""
    counts = small_counts()
    model = Model(counts)
    squares = [np.full_like(p, 1e-4) for p in model.parts()]
    rng = np.random.default_rng(0)
    cycle = np.array([1, 600, 3, 900, 700, 20])
    words = np.tile(cycle, 20_000)
    one, two = np.roll(words, 1), np.roll(words, 2)
    for a in range(0, len(words), 1000):
        part = slice(a, a + 1000)
        model.train(words[part], one[part], two[part], rng.choice(counts.choices, 64, p=counts.chance), counts, rng, squares)
    assert model.log_chance(words[6:12], one[6:12], two[6:12], counts).mean() > math.log(0.7)


def test_units_grow_with_the_input():
    assert own_units(1) < own_units(4) / 1.9 < own_units(100) / 9


def test_scores_do_not_depend_on_partitions(spark):
    rows = corpus(9, 90)
    found = [sorted(((str(r.doc_id), r.n_tokens, r.score) for r in score(docs(spark, rows).repartition(n), 3000).collect())) for n in (1, 5)]
    assert found[0] == found[1]


def test_long_and_tied(spark):
    rows = [(1, "a b c d " * 150_000), (3, "e f g h"), (4, "e f g h"), (5, "e f g h")]
    got = {r.doc_id: r for r in score(docs(spark, rows)).collect()}
    assert got[1].n_tokens == 600_001 and math.isfinite(got[1].score) and got[3].score == got[4].score == got[5].score < 0


def test_empty_and_all_held_out(spark):
    assert score(docs(spark, [(1, "a")]).limit(0)).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score(docs(spark, [(i, "a b")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_alias_tables_keep_the_chances():
    from keyflow.llm.lm import alias

    rng = np.random.default_rng(1)
    sizes = [1, 0, 2, 7, 300]
    edges = np.cumsum([0, *sizes])
    chance = np.concatenate([(w := rng.pareto(1, n) + 0.01) / w.sum() for n in sizes if n])
    keep, other = alias(chance, edges)
    got = np.zeros(len(chance))
    group = np.repeat(np.arange(len(sizes)), sizes)
    assert (group[other] == group).all()
    np.add.at(got, np.arange(len(chance)), keep / np.array(sizes)[group])
    np.add.at(got, other, (1 - keep) / np.array(sizes)[group])
    assert np.allclose(got, chance, atol=1e-6)


@pytest.mark.parametrize("spread", [0.3, 4.0, 40.0])
def test_norms_are_products_of_few_exponentials(monkeypatch, spread):
    """As by each context's scores, also where factors or sums are out of range; otherwise exponentials go by units, not by contexts."""
    from keyflow.llm import lm

    counts = small_counts()
    model = Model(counts)
    rng = np.random.default_rng(4)
    model.context[:] = rng.normal(0, spread, model.context.shape)
    model.target += rng.normal(0, 0.3, model.target.shape).astype(np.float32)
    one, two = (rng.integers(0, 40, 6000) for _ in range(2))
    units = rng.integers(0, counts.frequent, 6000)
    taken = []
    was = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, **more: (taken.append(np.size(x)), was(x, **more))[1])
    got = model.log_chance(units, one, two, counts)
    monkeypatch.undo()
    if spread < 1:
        assert sum(taken) < 100 * counts.choices
    monkeypatch.setattr(lm, "ROOM", 8192)  # a few choices at a time
    assert np.allclose(model.log_chance(units, one, two, counts), got, rtol=1e-5, atol=1e-4)
    h = np.column_stack([model.context[one].astype(float) @ model.place[0] + model.context[two].astype(float) @ model.place[1], np.ones(6000)])
    scores = h @ model.target.T.astype(float)
    top = scores.max(1)
    want = scores[np.arange(6000), units] - top - np.log(was(scores - top[:, None]).sum(1))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_distinct_numbers_and_their_places():
    from keyflow.llm.lm import distinct_of

    rng = np.random.default_rng(5)
    for values in (np.zeros(0, np.uint64), np.array([7], np.uint64), rng.integers(0, 1 << 64, 500, np.uint64)[rng.integers(0, 500, 3000)]):
        for a, b in zip(distinct_of(values), np.unique(values, return_inverse=True), strict=True):
            assert a.dtype == b.dtype and (a == b).all()


def test_norms_read_the_choices_once_however_many_units_come_first(monkeypatch):
    """Only the exponentials of the second place need room for all units; those of the first are made by blocks."""
    from keyflow.llm import lm

    counts = small_counts()
    model = Model(counts)
    rng = np.random.default_rng(6)
    model.context[:] = rng.normal(0, 0.5, model.context.shape)
    one, two = np.repeat(np.arange(900), 3), np.tile([1, 5, 30], 900)
    h = model.hidden(one, two)
    taken = []
    was = np.take
    monkeypatch.setattr(lm, "ROOM", 4 * (lm.BLOCK + 3) * counts.choices)
    monkeypatch.setattr(lm.np, "take", lambda *more: (taken.append(1), was(*more))[1])
    got = model.norms(one, two, h)
    monkeypatch.undo()
    assert len(taken) < 1.1 * 900
    assert np.allclose(got, np.log(np.exp(h.astype(float) @ model.target.T).sum(1)), rtol=1e-5, atol=1e-4)


def test_a_step_against_single_tokens():
    """Of frequent units, with repeated contexts and noise."""
    counts = small_counts()
    model, plain = Model(counts), Model(counts)
    squares = [np.full_like(p, 1e-4) for p in model.parts()]
    rng = np.random.default_rng(7)
    for part, same in zip(model.parts(), plain.parts(), strict=True):
        part += rng.normal(0, 0.3, part.shape).astype(np.float32)
        same[...] = part
    units, one, two = rng.integers(0, 257, 3000), rng.integers(0, 40, 3000), rng.integers(20, 60, 3000)
    noise = rng.choice(counts.choices, 64, p=counts.chance)
    model.train(units, one, two, noise, counts, rng, squares)
    grads = [np.zeros(p.shape) for p in plain.parts()]
    for u, a, b in zip(units.tolist(), one.tolist(), two.tolist(), strict=True):
        h = np.append(plain.context[a] @ plain.place[0] + plain.context[b] @ plain.place[1], 1).astype(float)
        off = 1 / (1 + np.exp(counts.log_noise[noise] - plain.target[noise] @ h))
        up = -1 / (1 + np.exp(plain.target[u] @ h - counts.log_noise[u]))
        grads[1][u] += up * h
        np.add.at(grads[1], noise, off[:, None] * h)
        back = (up * plain.target[u] + off @ plain.target[noise])[:-1]
        grads[0][a] += plain.place[0] @ back
        grads[0][b] += plain.place[1] @ back
        grads[3] += np.stack([np.outer(plain.context[a], back), np.outer(plain.context[b], back)])
    for got, was, g in zip(model.parts(), plain.parts(), grads, strict=True):
        g = g / 3000
        assert np.allclose(got, was - 0.08 * g / np.sqrt(1e-4 + g * g), atol=2e-4)
