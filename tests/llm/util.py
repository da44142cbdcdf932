import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use names of inside.
CLASHING = ("batch", "size", "k", "h", "node", "words", "good", "slot", "gone", "low", "d1", "mix_key", "MIX_HASH", "mix_copy", "block_hits", "block_items", "t", "d", "full", "edge", "__k", "__id", "__hits")


def docs(spark, rows):
    """Rows of (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}é"[: rng.choice([3, 4, 5])] for _ in range(n))


def corpus(seed: int = 0, n: int = 60):
    """Documents with exact and near copies, shared passages, repeats within, odd white space, and nulls."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 2, 5, 40, 120, 300])) for _ in range(n)]
    rows = [*base]
    for t in base[: n // 3]:
        words = t.split(" ")
        rows.append(t)
        rows.append(" ".join(w if rng.random() > 0.02 else "changed" for w in words))
        rows.append(prose(rng, 30) + " " + base[5] + base[3] + " " + prose(rng, 10))
    rows += ["", None, "   \n\t ", "one", "Two words", "same " * 200, "aaaa" * 100, "ñ" * 300, "x\x0by\x0cz\r\n1"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)] + [(None, base[0]), (None, None)]


def words(text):
    return (text or "").encode().lower().split()
