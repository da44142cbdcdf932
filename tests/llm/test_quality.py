import random

import numpy as np

from keyflow.llm.quality import fit_logistic, keep_good, score, squash, train

from .util import clashing, docs, prose

SCHEMA = "doc_id long, quality int, toxic int"


def cases(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        text = prose(rng, rng.choice([30, 80, 200]), 300)
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        if kind == "junk":
            text = rng.choice([" ".join([text.split(" ")[0]] * 60), text.upper().replace(" ", "!! "), text.replace(" ", " | ")])
        if kind == "toxic":
            text += rng.choice([" vileword", " nastyword", " foulword"])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(text)))
        truth[i] = kind
        if i % 4:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = cases()
    got = score(clashing(docs(spark, rows)), spark.createDataFrame(labels, SCHEMA)).collect()
    unseen = [r for r in got if r.doc_id % 4 == 0]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.kept == (truth[r.doc_id] == "good") for r in unseen]) > 0.93
    assert np.mean([r.kept for r in unseen if truth[r.doc_id] == "good"]) > 0.95


def test_kept_rows_have_all_columns(spark):
    rows, labels, _ = cases()
    df, known = clashing(docs(spark, rows)), spark.createDataFrame(labels, SCHEMA)
    kept = keep_good(df, known)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in score(df, known).filter("kept").collect())


def test_odd_rows_and_tables(spark):
    rows, labels, _ = cases(200)
    odd = [(None, None, None, None, None), (900, "", "", "", 0), (900, "", "", "", 0), (901, "x" * 300_000, "en", "s", -5)]
    labels += [(None, 1, 0), (5, None, None), (6, 1, None), (6, 0, 0), (99999, 1, 1)]
    got = score(docs(spark, [*rows, *odd]), spark.createDataFrame(labels, SCHEMA)).collect()
    assert len(got) == len(rows) + 4 and len({r.score for r in got if r.doc_id == 900}) == 1
    none = spark.createDataFrame([], SCHEMA)
    assert {(r.score, r.kept) for r in score(docs(spark, rows), none).collect()} == {(None, True)}
    assert keep_good(docs(spark, rows), none).count() == len(rows)
    assert score(docs(spark, rows).limit(0), spark.createDataFrame(labels, SCHEMA)).count() == 0


def test_logistic_fit_recovers_a_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 1))
    y = (rng.random(20_000) < squash(2 * x[:, 0] - 1)).astype(float)
    assert np.allclose(fit_logistic(x, y, np.ones(20_000), 1e-6), [2, -1], atol=0.1)


def test_pseudo_labels_grow_with_the_unlabelled_table(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(4000):
        good = rng.random() < 0.5
        text = prose(rng, 20, 60) + ("" if good else " vileword")
        rows.append((i, text, "en", "s0" if good else "s1", len(text)))
        if i % 10 == 0:
            labels.append((i, int(good), 0))
    model = train(docs(spark, rows), spark.createDataFrame(labels, SCHEMA))
    assert min(model.pseudo) > 1000  # 15 % of 3,600 documents, in either class
