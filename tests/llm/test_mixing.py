import pytest
from pyspark.sql import functions as F

from keyflow.llm.mixing import mix, mixed, targets

from .util import clashing, corpus, docs


def sourced(rows):
    names = ["b", "a", None, "c", "hot", "hot", "hot"]
    return [(i, t, "en", names[n % 7], None) for n, (i, t) in enumerate(rows)]


def water_level(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above a cap is shared again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        share = {s: out[s] + left * w[s] / total for s in free}
        left = sum(max(0.0, share[s] - most * sizes[s]) for s in free)
        out.update({s: min(v, most * sizes[s]) for s, v in share.items()})
        free = {s for s in free if out[s] < most * sizes[s]}
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 5, "c": 1000, "d": 3}, {"a": 5}, {"a": 0, "b": 0}, {"x": 1, "y": 1, "z": 1, "Z": 900}])
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()
    expected = water_level(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(expected)


def test_mix_takes_what_its_sources_should_give(spark):
    rows = sourced(corpus(9, 90))
    got = mixed(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(r.size for r in got)
    goal = water_level(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    for s, t in taken.items():
        assert abs(t - goal[s]) <= largest
    again = mixed(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    out = mix(clashing(docs(spark, rows)))
    assert out.columns == clashing(docs(spark, rows)).columns
    assert out.count() == sum(r.copies for r in got)
    assert out.agg(F.sum(F.when(F.col("doc_id").isNull(), 1))).first()[0] in (None, *range(7))


def test_empty(spark):
    assert mixed(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert [r.taken for r in mixed(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
