"""The queries of this subpackage: thin, whole tables, production parameters; digests are derived from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm.chat import BEGIN, END, TEXT, format_conversations, read_back
from kvstrata.llm.embedding_dedup import near_duplicates as near_vectors
from kvstrata.llm.html_extract import extract
from kvstrata.llm.langid import identify_held_out
from kvstrata.llm.minhash import near_duplicates as near_documents
from kvstrata.llm.packing import pack_documents
from kvstrata.llm.sentencepiece_codec import encode_documents
from kvstrata.llm.sharding import shard
from kvstrata.llm.substring_dedup import remove_repeats
from kvstrata.llm.topk import top_k


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("piece_bpe_32k.model"))
    return pieces.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).alias("n_bytes"),
    )


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    bpe = tokenizer_file("byte_bpe_50k.json")
    back = read_back(format_conversations(turns, bpe), bpe)
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring": op3_substring,
    "op4_chat": op4_chat,
    "op5_pack": op5_pack,
    "op6_html": op6_html,
    "op7_shard": op7_shard,
    "op8_langid": op8_langid,
    "op9_topk": op9_topk,
    "op10_embeddings": op10_embeddings,
}

OP9_SQL = """
WITH fine AS (
    SELECT vec_id, row_number() OVER () AS one, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
    FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id, c.one
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_COMPONENTS = """reach(id, r) AS (
    SELECT id, id FROM ids UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
)"""

OP1_SQL = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y USING (s) JOIN sizes n ON n.doc_id = x.doc_id JOIN sizes m ON m.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(n.n) + any_value(m.n) - count(*))
), ids AS (SELECT DISTINCT doc_id AS id FROM documents), {_COMPONENTS}, least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM docs d JOIN least ON id = d.doc_id LEFT JOIN sizes USING (doc_id)
"""

OP3_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
), repeated AS (
    SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), gone AS (
    SELECT doc_id, list(DISTINCT k) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM repeated) GROUP BY doc_id
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs
), kept AS (
    SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id WHERE g.places IS NULL OR NOT list_contains(g.places, k) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs d LEFT JOIN kept USING (doc_id)
"""

_ESCAPED = "length(replace(replace({0}, chr(92), repeat(chr(92), 2)), '<', chr(92) || 'l'))"
OP4_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), parts AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {len(BEGIN + TEXT + END)}) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM parts
"""

OP10_SQL = f"""
WITH RECURSIVE fine AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), ids AS (SELECT DISTINCT vec_id AS id FROM embeddings), {_COMPONENTS}, least AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least ON id = vec_id LEFT JOIN counts ON a = vec_id
"""

#: The others can't be expressed in SQL (tokenisers, page extraction, learned models, placement by Spark's hash).
ORACLES: dict[str, str] = {
    "op1_minhash": OP1_SQL,
    "op3_substring": OP3_SQL,
    "op4_chat": OP4_SQL,
    "op9_topk": OP9_SQL,
    "op10_embeddings": OP10_SQL,
}
