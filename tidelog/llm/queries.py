"""The registered queries of the corpus operators; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontamination, language, licenses, neardup, quality, secrets, substrings, surrogates, topk
from tidelog.llm.shared import read, settling


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"), size=3, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents"))


def _released(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; what it has settled goes if it fails."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with settling(spark, always=False):
            return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _released(f) for f in (op1_secret_scan, op2_license_scan, op3_exact_top_k, op4_benchmark_decontamination, op5_substring_dedup, op6_quality_classifier, op7_bpe, op8_minhash_near_dedup, op9_language_id, op10_pii_surrogates)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANKS = r"[^\x20\x09-\x0D]+"

#: DuckDB SQL of those that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (
          SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        asked AS (SELECT vec_id, arg_min(q, embedding) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
        scored AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM asked a JOIN v b ON a.vec_id <> b.vec_id),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op4_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
        b AS (SELECT DISTINCT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM benchmark) WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM b, unnest(range(1, len(w) - k + 2)) t(i)),
        dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM b), unnest(range(1, len(w) - k + 2)) t(i)),
        hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
        covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)""",
    "op5_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_BLANKS}'), []) AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) t(i)),
        hit AS (SELECT doc_id, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_BLANKS}'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) t(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.b, d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}
