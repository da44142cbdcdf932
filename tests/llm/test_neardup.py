import pytest

from keyflow.llm.neardup import connected, deduplicate, near_duplicates
from keyflow.llm.scratch import Scratch

from .util import clashing, corpus, docs, words


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus(1)
    got = near_duplicates(clashing(docs(spark, rows)), width, percent).collect()
    assert len(got) == len(rows)
    expected = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_a_large_group_of_near_copies(spark):
    """Most are linked to some, few to all: stars around hubs don't settle it."""
    import random

    rng = random.Random(3)
    first = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(300):
        edits = rng.choice([0, 1, 2, 3, 6, 9, 14])
        w = list(first)
        for p in rng.sample(range(150), edits):
            w[p] = f"e{rng.randrange(20)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e F")]
    got = near_duplicates(docs(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False)]
    assert near_duplicates(docs(spark, rows).limit(0), 3, 85).count() == 0
    kept = deduplicate(clashing(docs(spark, rows)))
    assert [r.doc_id for r in kept.collect()] == [3] and "slot" in kept.columns


def test_a_shuffled_chain_is_one_component(spark):
    import random

    ids = list(range(1000))
    random.Random(4).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (2000, 2001)], "a long, b long")
    got = {r.node: r.label for r in connected(links, Scratch(spark, "chain"), "chain").collect()}
    assert got == {**dict.fromkeys(range(1000), 0), 2000: 2000, 2001: 2000}


def test_rounds_of_components_read_only_links_that_are_left(spark, monkeypatch):
    import random

    order = random.Random(4).sample(range(1000), 1000)
    pairs = [*zip(order, order[1:], strict=False), *((k, k + 1) for k in range(2000, 2500)), *((3000, k) for k in range(3001, 3500))]
    written, save = [], Scratch.save

    def counted(self, name, df):
        out = save(self, name, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = {r.node: r.label for r in connected(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "rounds"), "rounds").collect()}
    assert got == {k: 0 for k in range(1000)} | {k: 2000 for k in range(2000, 2501)} | {k: 3000 for k in range(3000, 3500)}
    assert sum(written) < 10 * len(pairs)
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "none"), "none").count() == 0


def test_rows_of_one_id_with_different_texts_lose_no_link(spark):
    from .util import prose

    rng = __import__("random").Random(8)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (5, c), (5, a[::-1])]
    got = near_duplicates(docs(spark, rows), 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} and len(got) == 7
    assert sorted(r.doc_id for r in deduplicate(docs(spark, rows), 3, 85).collect()) == [1, 1, 4]


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 9973}x{i % 7919}" for i in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, "short text of some words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == {1: (399_998, 1), 2: (399_999, 1), 3: (3, 3)}


def test_copies_with_many_own_edits_do_not_meet_all_pairs(spark, monkeypatch):
    """200 copies of which many are linked with none: far from all 19,900 pairs are made, and components are those of brute force."""
    import random

    from keyflow.llm import neardup

    rng = random.Random(6)
    first = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(200):
        w = list(first)
        for p in rng.sample(range(300), rng.choice([3, 5, 6, 7, 8])):
            w[p] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    made, find = [], neardup.prefix_pairs

    def counted(*args):
        made.append(find(*args))
        return made[-1]

    monkeypatch.setattr(neardup, "prefix_pairs", counted)
    counts = []
    keep = neardup.Scratch.drop
    monkeypatch.setattr(neardup.Scratch, "drop", lambda self, *names: (counts.extend(m.count() for m in made if "rest-prefix" in names), keep(self, *names)))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), 3, 85).collect()}
    expected = {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert got == expected and len(set(expected.values())) > 20
    assert len(counts) == 1 and counts[0] < 4000
