"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.media import media_table

    return media_table(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.html_extraction import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaugework.llm.token_files import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaugework.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"), least=0.5)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.fingerprints import fingerprint_table

    return fingerprint_table(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gaugework.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs["doc_id"])))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), words=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3, share=1.0)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugework.llm.importance import resample

    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: The text with A to Z alone lower-cased.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of x's bytes: a table of 256 values, and one step a byte.
CRC_TABLE = """SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT)),
      lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])), 4294967295)"""

RESAMPLING = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    f AS (SELECT row, unnest(w) AS x FROM d), o AS (SELECT unnest(w) AS x FROM b),
    k AS (SELECT x, {CRC} % 10000 AS bucket FROM (SELECT x FROM f UNION SELECT x FROM o), ({CRC_TABLE})),
    s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM o JOIN k USING (x) GROUP BY bucket),
    g AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
      / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT row, floor(sum(gain) / count(*)) AS weight FROM f JOIN k USING (x) JOIN g USING (bucket) GROUP BY row),
    r AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0)
      + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN m USING (row)),
    a AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM r WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM r LEFT JOIN a USING (row)"""


SEARCH = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
    c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
    p AS (SELECT row, x, count(*) AS tf FROM (SELECT row, unnest(w) AS x FROM d) GROUP BY row, x),
    f AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT x, count(*) AS df FROM p GROUP BY x), c),
    q AS (SELECT item, item_id, x, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS x FROM i) GROUP BY ALL),
    m AS (SELECT row, doc_id, 100 - 25 + (25 * CAST(len(w) AS BIGINT) * n) // words AS m FROM d, c),
    s AS (SELECT item, item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (x) JOIN p USING (x) JOIN m USING (row) GROUP BY item, item_id, row, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
      FROM s WHERE score > 0) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; hashes, tokenizers, models and codecs are held against brute force in the tests."""
    return {"op11_lexical_search": SEARCH, "op13_importance_resampling": RESAMPLING}
