import hashlib
import random
import re

import pytest

from keyflow.llm import decontaminate as d

from .util import clashing, corpus, docs, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").encode().lower())


def brute(rows, items, window=10):
    owners = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if o := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= o
        out.append((i, len(w), len(hit), sorted(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "ITEM_BYTES", block)
    rng = random.Random(1)
    items = [(n, prose(rng, rng.choice([3, 9, 10, 11, 25]), 30)) for n in range(20)]
    items += [(100, items[3][1]), (101, ""), (102, None), (103, "single"), (104, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    rows = corpus(11)
    rows += [(1000 + n, f"{prose(rng, 5, 30)} {items[n % 20][1].upper()}! {prose(rng, 20, 30)}, {items[(n * 7) % 20][1]}") for n in range(40)]
    rows += [(2000, "w1 " * 40), (2001, "Single, single-single")]
    got = d.scan(clashing(docs(spark, rows)), table(spark, items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.items_sha256) for r in got), key=str) == brute(rows, items)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_hit


def test_cleaning(spark, monkeypatch):
    rng = random.Random(2)
    item = prose(rng, 20, 10**6)
    clean, long = prose(rng, 50, 10**6), prose(rng, 100, 10**6)
    rows = [(1, clean), (2, f"{long} {item} {long}"), (3, f"only {item}"), (4, None), (5, "")]
    for block in (4_000_000, 10):
        monkeypatch.setattr(d, "ITEM_BYTES", block)
        df = d.decontaminate(clashing(docs(spark, rows)), table(spark, [(1, item), (2, "other words"), (3, "more of them")]))
        assert {r.doc_id: r.text for r in df.collect()} == {1: clean, 2: f"{long}  {long}", 4: None, 5: ""}
        assert df.columns == clashing(docs(spark, rows)).columns


def test_empty_tables(spark):
    rows = [(1, "a b")]
    assert [r.n_hit for r in d.scan(docs(spark, rows), table(spark, [])).collect()] == [0]
    assert d.scan(docs(spark, rows).limit(0), table(spark, [(1, "a")])).count() == 0
    assert d.decontaminate(docs(spark, rows), table(spark, [])).count() == 1
