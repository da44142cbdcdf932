import re

from keyflow.llm.licenses import LEAST, TEMPLATES, scan

from .util import clashing, corpus, docs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(raw):
    w = WORD.findall(raw.lower())
    return {*zip(w, w[1:], strict=False)}


def brute(text, templates, least):
    raw = (text or "").encode()
    parts = raw.split(b"\n") + re.split(rb"\n(?:[ \t\r\x0b\x0c]*\n)+", raw) + [raw]
    found = [(-2 * len(g & t) / (len(g) + len(t)), n) for g in map(grams, parts) if g for n, t in templates.items()]
    best = min((f for f in found if -f[0] >= least), default=None)
    return (best[1], -best[0]) if best else (None, None)


def test_nearest_templates_equal_brute_force(spark):
    rows = corpus(12)
    names = sorted(TEMPLATES)
    for n, name in enumerate(names):
        t = TEMPLATES[name]
        half = t.split(" ")
        rows += [
            (1000 + 10 * n, f"Some words before.\n{t}\nAnd after it"),
            (1001 + 10 * n, " ".join(half[: len(half) // 2]) + "\n" + " ".join(half[len(half) // 2 :]) + "\n \nmore words here"),
            (1002 + 10 * n, t.upper().replace("LICENSE", "LICENCE")),
            (1003 + 10 * n, f"inline {t} inline"),
        ]
    templates = {n: grams(t.encode()) for n, t in TEMPLATES.items()}
    got = scan(clashing(docs(spark, rows))).collect()
    assert sorted(((r.doc_id, r.license, r.dice) for r in got), key=str) == sorted(((i, *brute(t, templates, LEAST)) for i, t in rows), key=str)
    texts = {i: t for i, t in rows if i is not None}
    for r in got:
        for m in r.matches if r.doc_id is not None else []:
            assert grams(texts[r.doc_id].encode()[m.start : m.end])


def test_other_templates_and_empty_tables(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha beta"), (3, None)]
    got = {r.doc_id: (r.license, r.dice) for r in scan(docs(spark, rows), {"b": "alpha beta gamma", "a": "Alpha, beta: GAMMA", "one": "alpha"}).collect()}
    assert got == {1: ("a", 1.0), 2: (None, None), 3: (None, None)}
    assert scan(docs(spark, rows).limit(0)).count() == 0
    assert {r.license for r in scan(docs(spark, rows), {}).collect()} == {None}
