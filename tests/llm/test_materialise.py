import base64

import numpy as np
import pytest

from keyflow.llm import materialise as m
from keyflow.llm.materialise import END, PATTERN, VOCABULARY, feistel, read_slots, training_order

from .util import clashing, corpus, docs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_the_permutation_is_one(n):
    for key in (0, 7, -3):
        assert sorted(feistel(np.arange(n), n, key).tolist()) == list(range(n))
    assert n < 64 or feistel(np.arange(n), n, 1).tolist() != feistel(np.arange(n), n, 2).tolist()


def test_every_sequence_has_a_slot_and_texts_come_back(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus(10)
    out = training_order(clashing(docs(spark, rows)), length=16).cache()
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(len(r.tokens) == 32 for r in got)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(np.frombuffer(r.tokens, np.uint16)[: r.n_tokens].tolist())
    for i, t in rows:
        if i is not None:
            ids = [x for k in sorted(by_doc[i]) for x in by_doc[i][k][0]]
            assert ids[-1] == END and encoding.decode(ids[:-1]) == (t or "")
    order = sorted(got, key=lambda r: r.slot)
    m.SHARD_BYTES = 320  # ten records
    try:
        folder = str(tmp_path / "shards")
        again = training_order(docs(spark, rows), length=16, folder=folder).collect()
    finally:
        m.SHARD_BYTES = 8 << 20
    assert sorted((r.slot, r.tokens) for r in again) == [(r.slot, r.tokens) for r in order]
    assert all((r.shard, r.position) == (r.slot // 10, r.slot % 10 * 32) for r in again)
    assert [s.tobytes() for s in read_slots(folder)] == [bytes(r.tokens) for r in order]
    assert [s.tobytes() for s in read_slots("file:" + folder, 15)] == [bytes(r.tokens) for r in order[15:]]
    stale = tmp_path / "shards" / f"shard-{-(-len(order) // 10):07d}.bin"
    stale.write_bytes(bytes(320))
    assert len([*read_slots(folder)]) == len(order)
    (tmp_path / "shards" / "shard-0000001.bin").write_bytes(bytes(31))
    with pytest.raises(ValueError):
        [*read_slots(folder)]
    (tmp_path / "shards" / "shard-0000001.bin").unlink()
    with pytest.raises(OSError):
        [*read_slots(folder)]
    assert [(r.slot, r.doc_id, r.piece) for r in training_order(docs(spark, rows), length=16).collect()] == [(r.slot, r.doc_id, r.piece) for r in got]


def test_repeated_rows_and_no_rows(spark):
    assert training_order(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert sorted((r.slot, r.doc_id) for r in training_order(docs(spark, [(1, "a"), (1, "a"), (1, None)])).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_long_texts_and_runs_of_shards(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BYTES", 64)
    monkeypatch.setattr(m, "PARTITIONS", 3)
    out = training_order(docs(spark, [(1, "word " * 200_000), (2, "a")]), length=1000)
    rows = out.select("slot", "n_tokens", "doc_id").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and sum(r.n_tokens for r in rows if r.doc_id == 1) > 200_000
    assert out.rdd.getNumPartitions() <= 3


def test_the_query_returns_what_its_shards_hold(spark, tmp_path, monkeypatch):
    from keyflow.llm import scratch
    from keyflow.llm.queries import op7_training_order

    monkeypatch.setattr(m, "SHARD_BYTES", 8 << 10)  # eight records
    shared = tmp_path / "shared"
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(shared))
    docs(spark, [*corpus(10), (7000, "word " * 9000)]).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = op7_training_order(spark, str(tmp_path))
    assert not [*shared.glob("order-*/ids")]
    plain = training_order(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert out.schema == plain.schema
    rows = out.collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and len(rows) > 8 * m.PASSES
    assert sorted(rows, key=lambda r: r.slot) == sorted(plain.collect(), key=lambda r: r.slot)
    (folder,) = shared.glob("shards-*")
    assert [s.tobytes() for s in read_slots(str(folder))] == [bytes(r.tokens) for r in rows]
    first = folder / "shard-0000000.bin"
    first.write_bytes(bytes(first.stat().st_size))  # what the query returns is what the files hold
    assert out.first().tokens == bytes(1024)
    assert training_order(docs(spark, [(1, "a")]).limit(0), folder=str(tmp_path / "none")).count() == 0


def test_ids_wait_in_zstd(spark, monkeypatch):
    from keyflow.llm.scratch import Scratch

    found, save = [], Scratch.save

    def noted(self, name, df, *args, **kwargs):
        out = save(self, name, df, *args, **kwargs)
        found.extend(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "save", noted)
    assert training_order(docs(spark, corpus(10))).count() > 0
    assert found and all(name.endswith(".zstd.parquet") for name in found)
