"""The registered queries: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import alignment, chat, decontam, langid, linededup, longmatch, neighbours, packing, pages, repair, sharding, simhash, substrings

#: File of the public word BPE; None: where the installed package has it.
TOKENIZER: str | None = None
HOSTILE = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    return chat.digests(chat.format_chats(given.union(extra)))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")
    return found.select("query_id", "rank", "vec_id", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return TOKENIZER or public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from the labelled documents that aren't held out."""
    return langid.learn(docs.where(~langid.held_out()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predictions(docs, language_model(docs))


def op8_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longmatch.passage_digests(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), sharding.tree_of(40))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignments(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    return repair.audited(repair.damaged(given), given)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_chat_format": op4_chat_format,
    "op5_neighbours": op5_neighbours,
    "op6_packing": op6_packing,
    "op7_language_id": op7_language_id,
    "op8_long_matches": op8_long_matches,
    "op9_sharding": op9_sharding,
    "op10_page_text": op10_page_text,
    "op11_alignment": op11_alignment,
    "op12_repair": op12_repair,
    "op13_substrings": op13_substrings,
}

#: A-Z in lower case, nothing else, in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
        keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM each),
        held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        judged AS (SELECT r, k.doc_id, line, place, h.key IS NULL OR k.doc_id = h.first AS stays FROM keyed k LEFT JOIN held h ON k.key = h.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
        FROM judged GROUP BY r, doc_id
    """,
    "op3_decontamination": f"""
        WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS w FROM benchmark),
        sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
        placed AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS place FROM sized),
        grams AS (SELECT DISTINCT item, n, array_to_string(w[place : place + n - 1], ' ') AS gram FROM placed),
        docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
        spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS place FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
        hits AS (SELECT r, place, n, item FROM (SELECT r, place, n, array_to_string(w[place : place + n - 1], ' ') AS gram FROM spots) JOIN grams USING (n, gram)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(place, place + n)) AS p FROM (SELECT DISTINCT r, place, n FROM hits)) GROUP BY r),
        found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
    """,
    "op4_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), marked AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS fresh,
                2 * length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS body,
                2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) AS head
            FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(body + CASE WHEN fresh THEN head + 14 ELSE 5 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
