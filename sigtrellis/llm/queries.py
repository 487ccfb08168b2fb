"""The registered opN_<name> queries and the corpus pipeline, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigtrellis.llm import ann, bpe, chat, decontam, html, linededup, omh, pii, tokens, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, against all rows."""
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the parameter that makes pseudonyms secret; this one is for tests."""
    return pii.report(read(spark, sf_dir, "documents"), key="a key for tests only")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents")).drop("dropped")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.texts(read(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts imitate the template's control strings."""
    posed = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", posed), (-7, 1, "assistant", posed)], "conv_id long, turn long, role string, text string")
    return chat.digest(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)).drop("n_windows")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest_neighbours, op2_pii_pseudonyms, op3_decontamination, op4_near_duplicates, op5_line_dedup, op6_byte_bpe, op7_html_text, op8_token_counts, op9_chat_format, op10_toxicity)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        cut AS (SELECT item_id, least(10, len(ws)) AS n, ws, unnest(range(greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i + 1 : i + n], ' ') AS gram FROM cut),
        place AS (SELECT doc_id, ws, s.n, unnest(range(len(ws) - s.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) s WHERE len(ws) >= s.n),
        seen AS (SELECT doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS gram FROM place),
        hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM seen JOIN win USING (n, gram)),
        word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op9_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        e AS (SELECT *, role = 'assistant' AS said, regexp_replace(text, '(\\*)(</?s>|\[/?INST\])', '\1\\\2', 'g') AS body FROM c),
        p AS (SELECT *, '<s>' || CASE WHEN said THEN '' ELSE '[INST]' END || url_encode(role) || chr(10) AS head, CASE WHEN said THEN chr(10) || '</s>' ELSE chr(10) || '[/INST]</s>' END AS tail FROM e),
        t AS (SELECT conv_id, role, text, said, length(head || body || tail) AS size, len(regexp_extract_all(head || body, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM p),
        s AS (SELECT *, max(CASE WHEN place = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS sys, max(CASE WHEN place = 1 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id) AS sys_size FROM t),
        a AS (SELECT *, CASE WHEN place = 1 AND sys IS NOT NULL THEN 0 ELSE tokens END AS counted, greatest(1024 - 256 - coalesce(sys, 0), 256) AS room FROM s),
        b AS (SELECT *, coalesce(sum(counted) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM a),
        o AS (SELECT *, place = 1 OR (start * 2) // room <> lag((start * 2) // room) OVER w OR counted * 2 > room OR lag(counted * 2 > room) OVER w AS opens FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
        h AS (SELECT o.conv_id, o.place, sum(q.size) AS history FROM o JOIN o q ON q.conv_id = o.conv_id AND q.place BETWEEN o.place - 8 AND o.place - 1
            AND o.start - q.start <= 256 AND NOT (q.place = 1 AND q.sys IS NOT NULL) WHERE o.opens GROUP BY ALL)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE said), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE said), '')) AS loss_sha256,
            CAST(sum(size + CASE WHEN opens AND place > 1 THEN coalesce(sys_size, 0) ELSE 0 END + coalesce(history, 0)) AS BIGINT) AS formatted_chars
        FROM o LEFT JOIN h USING (conv_id, place) GROUP BY conv_id""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
        k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS k FROM l),
        bad AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE keeper <> doc_id) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN bad USING (k) GROUP BY doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
