import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .test_decontaminate import brute as contaminated  # noqa: E402
from .test_neardup import brute as components  # noqa: E402
from .test_quality import SCHEMA as LABELS  # noqa: E402
from .util import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    items = [(n, prose(rng, 20, 10**6)) for n in range(5)]
    rows, labels, kind = [], [], {}
    for i in range(300):
        text = prose(rng, rng.choice([40, 90, 150]), 10**6)
        what = rng.choice(["clean", "clean", "clean", "junk", "toxic", "copy", "near", "leak"]) if i > 20 else "clean"
        if what == "junk":
            text = text.upper().replace(" ", "!! ")
        elif what == "toxic":
            text += " vileword"
        elif what in ("copy", "near"):
            text = rows[rng.randrange(20)][1] + ("" if what == "copy" else " end")
        elif what == "leak":
            text += " " + items[i % 5][1]
        rows.append((i, text, "en", rng.choice(["a", "b", "c"]), len(text)))
        kind[i] = what
        if i % 3:
            labels.append((i, int(what != "junk"), int(what == "toxic")))
    path = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, LABELS), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return path, rows, items, kind


def test_stages(spark, folder):
    path, rows, items, kind = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert len(stages) in (4, 5)
    good = stages["quality classifier"](spark, docs, path)
    left = {r.doc_id: r.text for r in good.collect()}
    assert sum(kind[i] in ("junk", "toxic") for i in left) <= 5
    assert sum(kind[i] not in ("junk", "toxic") for i in left) >= 0.97 * sum(k not in ("junk", "toxic") for k in kind.values())

    one = stages["MinHash near-dedup"](spark, good, path)
    kept = {r.doc_id for r in one.collect()}
    assert kept == {i for i, (_, c) in components([*left.items()], 5, 80).items() if i == c}

    clean = stages["benchmark decontamination"](spark, one, path)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert not any(r[2] for r in contaminated([*texts.items()], items))
    assert all(texts[i] == left[i] for i in texts if kind[i] != "leak")
    assert {i for i in kept if kind[i] != "leak"} <= set(texts)

    mixed = stages["mixing sources to target weights"](spark, clean, path)
    for df in (good, one, clean, mixed):
        assert df.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= set(texts)
    last = stages["token-ID / binary output"](spark, mixed, path)
    n = last.count()
    assert sorted(r.slot for r in last.select("slot").collect()) == list(range(n))


def test_run_is_its_stages(spark, folder):
    path = folder[0]
    out = pipeline.run(spark, path).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted((r.doc_id, r.piece, bytes(r.tokens)) for r in docs.collect()) == sorted((r.doc_id, r.piece, bytes(r.tokens)) for r in out)
