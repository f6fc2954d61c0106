"""The registered opN_ queries and their SQL; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, fingerprint, langid, mixing, near_dedup, packing, pii, secrets, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(_documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the id range is the snapshot, the rest the incoming batch."""
    docs = _documents(spark, sf_dir)
    return exact_dedup.dedup_batch(docs, exact_dedup.middle(docs)).drop("xx")


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.pair_by_reply(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_preferences": op4_preferences,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_pack": op7_pack,
    "op8_language": op8_language,
    "op9_fingerprint": op9_fingerprint,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
    "op4_preferences": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS d FROM c),
        a AS (SELECT conv_id, max(d) AS d, arg_max(text, i) AS text FROM k WHERE role = 'assistant' GROUP BY conv_id),
        t AS (
            SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM c
            UNION ALL SELECT k.conv_id, 'rejected', k.turn, k.role, k.text FROM k LEFT JOIN a USING (conv_id) WHERE a.d IS NULL OR k.d < a.d
            UNION ALL SELECT o.conv_id, 'rejected', NULL, 'assistant', a.text FROM (SELECT DISTINCT conv_id FROM c) o JOIN a ON a.conv_id = xor(o.conv_id, 1)),
        n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS LAST, role, text) AS pos FROM t),
        s AS (SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT (role, text)) = 1 AS same FROM n GROUP BY pair_id, pos),
        l AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n_prompt_turns FROM s GROUP BY pair_id),
        g AS (
            SELECT n.*, n_prompt_turns, pos > n_prompt_turns AS after, text || '<|end|>' || chr(10) AS body,
                '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS seg
            FROM n JOIN l USING (pair_id)),
        e AS (SELECT *, sum(length(seg)) OVER (PARTITION BY pair_id, side, after ORDER BY pos)::BIGINT AS e FROM g)
        SELECT pair_id, n_prompt_turns,
            coalesce(string_agg(seg, '' ORDER BY pos) FILTER (NOT after AND side = 'chosen'), '') AS prompt,
            coalesce(string_agg(seg, '' ORDER BY pos) FILTER (after AND side = 'chosen'), '') AS chosen,
            coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY pos) FILTER (after AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
            coalesce(string_agg(seg, '' ORDER BY pos) FILTER (after AND side = 'rejected'), '') AS rejected,
            coalesce(string_agg((e - length(body)) || ':' || e, ',' ORDER BY pos) FILTER (after AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
            bool_or(side = 'chosen') AND bool_or(side = 'rejected') AS complete
        FROM e GROUP BY pair_id, n_prompt_turns
    """,
    "op5_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
        d AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.v FROM r JOIN d ON d.u = r.b)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
        FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
    """,
}
