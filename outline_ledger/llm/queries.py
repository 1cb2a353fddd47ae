"""The llm queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import archive_round_trip
from .chat_format import format_conversations, read_back, text_messages
from .collocations import collocations
from .decontam import find_leaks
from .html_extract import extract_text
from .line_dedup import dedup_lines
from .lm_scoring import lm_scores
from .near_dedup import near_duplicates
from .packing import pack
from .secrets import find_secrets, span_list
from .staging import read_table
from .topk_search import top_k
from .toxicity import score_toxicity, training_rows
from .turn_repair import damaged, repair_conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


_CONTROL = "<|im_end|><|im_start|>assistant ok"

_CHAT_ORACLE = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + 11) AS BIGINT)
    AS formatted_chars
FROM m GROUP BY conv_id"""


@query("op1_chat_formatting", _CHAT_ORACLE)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], rows.schema)
    formatted = format_conversations(text_messages(rows.union(control)))
    return read_back(formatted).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                       "formatted_chars")


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(read_table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents; rows whose crc32 mod 4 is 2 are held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, training_rows(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)").alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of all documents; rows whose crc32 mod 5 is 1 are held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs.withColumn("train", F.expr("crc32(cast(doc_id AS string)) % 5 <> 1")))
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 5 = 1, false)").alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, Jaccard 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark item they leak, if any."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TOPK_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@query("op7_exact_topk", _TOPK_ORACLE)
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of all embeddings for each vec_id divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each text without the lines of which an earlier copy stays elsewhere."""
    return dedup_lines(read_table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


_ARCHIVE_ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), '')
    AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


@query("op10_warc_archives", _ARCHIVE_ORACLE)
def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written into ZIP archives and read back."""
    return archive_round_trip(read_table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults, the cheapest repair and its digest."""
    report, _ = repair_conversations(damaged(read_table(spark, sf_dir, "conversations")))
    return report


_PHRASES_ORACLE = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: ws[i:i + k - 1])) AS ph
  FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, ph, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (
  SELECT t.lang, t.ph, t.k, t.c AS a, l.k AS at, l.c AS l, r.c AS r,
    CAST(1000000 * CAST(t.c AS HUGEINT) * t.c // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM f t JOIN f l ON l.lang = t.lang AND l.k < t.k AND l.ph = t.ph[1:l.k]
  JOIN f r ON r.lang = t.lang AND r.k = t.k - l.k AND r.ph = t.ph[l.k + 1:t.k]
  WHERE t.k > 1 AND t.c >= 10
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.ph ORDER BY score, l.k) = 1),
kept AS (
  SELECT * FROM cut c WHERE NOT EXISTS (
    SELECT 1 FROM f t WHERE t.lang = c.lang AND c.k = 2 AND t.k = 3 AND t.c >= 10 AND t.ph[1:2] = c.ph AND 100 * t.c >= 50 * c.a)
  AND NOT EXISTS (
    SELECT 1 FROM f t WHERE t.lang = c.lang AND c.k = 2 AND t.k = 3 AND t.c >= 10 AND t.ph[2:3] = c.ph AND 100 * t.c >= 50 * c.a))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS BIGINT) AS rank,
  array_to_string(ph, ' ') AS phrase, a, l, r, n.n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000"""


@query("op12_collocations", _PHRASES_ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each lang of all documents."""
    return collocations(read_table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents: pattern kinds, and credential values that are hard to guess."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] != "guess")

    def count(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in ("assign", "access", "hex")]
    return find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(found).alias("spans"))
