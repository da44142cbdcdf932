import hashlib
import random

import numpy as np
import pytest

from keyflow.llm.bwt import prefix_groups
from keyflow.llm.chunks import LEAST, MOST, cuts, dedup_chunks
from keyflow.llm.suffixes import clean, repeated_bytes

from .util import clashing, corpus, docs, prose


@pytest.mark.parametrize("seed", range(40))
def test_prefix_groups_equal_comparison(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(2, 5), rng.integers(1, 200)).astype(np.uint8)
    text = np.concatenate([text, text[: len(text) // 2], [9], text]).astype(np.uint8)
    length = int(rng.integers(1, 30))
    order, begins = prefix_groups(text, length)
    group = np.cumsum(begins)
    raw, seen = text.tobytes(), {}
    for at, i in enumerate(order):
        if i + length <= len(raw):
            seen.setdefault(raw[i : i + length], set()).add(group[at])
    assert all(len(g) == 1 for g in seen.values()) and len({*map(tuple, seen.values())}) == len(seen)


def brute_bytes(rows, length):
    """n_bytes, n_removed, n_spans and the digest of what is left, by document id."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            k = b[j : j + length]
            first[k] = min(first.get(k, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < (float("inf") if i is None else i):
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [2_000, 1 << 22])
def test_repeated_bytes_equal_brute_force(spark, batch):
    rows = corpus(2)
    got = repeated_bytes(clashing(docs(spark, rows)), 50, batch).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got), key=str) == brute_bytes(rows, 50)


def test_rows_of_one_id_and_empty_tables(spark):
    text = prose(random.Random(1), 60)
    rows = [(2, text), (2, text), (1, "other " + text)]
    got = repeated_bytes(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, len(text.encode())), (2, len(text.encode()))]
    assert repeated_bytes(docs(spark, rows).limit(0)).count() == 0
    assert {r.doc_id: r.text for r in clean(docs(spark, rows)).collect()} == {1: "other " + text, 2: ""}


def test_cuts_resist_shifts():
    rng = random.Random(4)
    text = prose(rng, 2000).encode()
    one, two = cuts(np.frombuffer(text, np.uint8)), cuts(np.frombuffer(b"inserted " + text, np.uint8))
    parts = lambda t, ends: {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    same = parts(text, one) & parts(b"inserted " + text, two)
    assert len(same) > 0.97 * len(one)
    for t, ends in ((text, one), (b"inserted " + text, two)):
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(t) and all(LEAST <= s <= MOST + 3 for s in sizes[:-1])
        assert all((t[e] & 0xC0) != 0x80 for e in ends[:-1])


def brute_chunks(rows, min_run):
    chunks = {n: [] for n in range(len(rows))}
    for n, (_, t) in enumerate(rows):
        b, at = (t or "").encode(), 0
        for e in cuts(np.frombuffer(b, np.uint8)):
            chunks[n].append(b[at:e])
            at = e
    key = lambda i: float("inf") if i is None else i
    low = {}
    for n, (i, _) in enumerate(rows):
        for c in chunks[n]:
            low[c] = min(low.get(c, float("inf")), key(i))
    out = []
    for n, (i, t) in enumerate(rows):
        seen, kept, run, gone, whole = set(), [], [], 0, len((t or "").encode())
        for c in [*chunks[n], None]:
            if c is not None and (low[c] < key(i) or c in seen):
                run.append(c)
                continue
            size = sum(map(len, run))
            goes = size and (size >= min_run or size == whole)
            gone += size if goes else 0
            kept += [] if goes else run
            run = []
            if c is not None:
                kept.append(c)
                seen.add(c)
        out.append((i, gone, None if t is None else b"".join(kept).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [3_000, 1 << 22])
def test_chunk_dedup_equals_brute_force(spark, batch):
    rows = corpus(5)
    got = dedup_chunks(clashing(docs(spark, rows)), batch_bytes=batch).collect()
    assert sorted(((r.doc_id, r.n_removed, r.text) for r in got), key=str) == brute_chunks(rows, 64)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert dedup_chunks(docs(spark, rows).limit(0)).count() == 0


def test_shared_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(6)
    passage = prose(rng, 55, 10**6)
    rows = [(i, f"{prose(rng, 80, 10**6)} {passage if i % 3 == 0 else ''} {prose(rng, 80, 10**6)}") for i in range(60)]
    got = {r.doc_id: r.n_removed for r in dedup_chunks(docs(spark, rows)).collect()}
    assert all((got[i] > 0) == (i % 3 == 0 and i > 0) for i in range(60))


def test_short_texts_that_are_repeated_go(spark):
    rows = [(1, "short repeated line"), (2, "short repeated line"), (3, "short repeated line"), (4, "another")]
    assert {r.doc_id: r.text for r in dedup_chunks(docs(spark, rows)).collect()} == {1: "short repeated line", 2: "", 3: "", 4: "another"}


def test_gear_hash_equals_a_rolling_loop():
    from keyflow.llm.chunks import GEAR, WINDOW, gear_hash

    data = np.frombuffer(random.Random(9).randbytes(300), np.uint8)
    got = gear_hash(data)
    for at in range(WINDOW - 1, len(data)):
        h = 0
        for byte in data[at - WINDOW + 1 : at + 1].tolist():
            h = (2 * h + int(GEAR[byte])) % (1 << 32)
        assert h == int(got[at])
