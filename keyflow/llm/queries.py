"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import MIX_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunks import dedup_chunks

    return dedup_chunks(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .materialise import training_order
    from .scratch import Scratch

    return training_order(table(spark, sf_dir, "documents"), folder=Scratch(spark, "shards").root)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_media_columns": op3_media_columns,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_source_mixing": op5_source_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_training_order": op7_training_order,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_license_scan": op10_license_scan,
}

#: Text in ASCII lower case.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
""".replace("{low}", LOW)

SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s - 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS s FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
t AS (SELECT DISTINCT doc_id, s FROM w JOIN f USING (g) WHERE low < doc_id),
b AS (SELECT doc_id, pos, substr(h, 2 * pos - 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(1, n + 1)) AS pos FROM d)),
m AS (SELECT b.doc_id, pos, byte, coalesce(max(t.s) OVER (PARTITION BY b.doc_id ORDER BY pos) >= pos - 49, false) AS gone FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.s = pos),
a AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS first FROM m),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM a GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

LEAK_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.k, x.n, g.item FROM x JOIN g ON g.n = x.n AND g.g = x.g),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
""".replace("{low}", LOW)

ORACLES: dict[str, str] = {
    "op4_near_duplicates": NEAR_SQL,
    "op5_source_mixing": MIX_SQL,
    "op6_suffix_dedup": SUFFIX_SQL,
    "op8_decontamination": LEAK_SQL,
}
