"""The queries of this subpackage and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lines, media, near_dups, packing, pieces, repeats, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=True)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(rows.unionByName(more)))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
      ELSE 14 + length(replace(replace(role, '\', '\\'), ']', '\]')) END
    + length(text) + len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\]|ANS\]|ROLE |/ROLE\])')) AS chars
  FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP8_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.*, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = toxicity.score(documents, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.col("__spans").alias("spans"),
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), common AS (
  SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {lines.MIN_SITES}
), m AS (
  SELECT l.*, common.line IS NOT NULL AS hit FROM l LEFT JOIN common ON l.line = common.line
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit,
    coalesce(bool_or(NOT hit AND trim(line) <> ''), false) AS cut,
    string_agg(line, chr(10) ORDER BY pos) AS whole,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT doc_id, n_lines, CASE WHEN cut THEN n_hit ELSE 0 END AS n_removed,
  CAST(length(CASE WHEN cut THEN kept ELSE whole END) AS BIGINT) AS kept_chars,
  sha256(CASE WHEN cut THEN kept ELSE whole END) AS kept_sha256
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_topk": op5_topk,
    "op6_near_dups": op6_near_dups,
    "op7_repeats": op7_repeats,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_lines": op10_lines,
}
SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op5_topk": OP5_SQL, "op8_warc": OP8_SQL, "op10_lines": OP10_SQL}
