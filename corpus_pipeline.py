"""The corpus pipeline: language identification, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which run() writes as Parquet to the shared folder and reads
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.llm.langid import UND, held_out, identify, learn
from kvstrata.llm.minhash import near_duplicates
from kvstrata.llm.packing import pack_documents
from kvstrata.llm.queries import tokenizer_file
from kvstrata.llm.storage import Scratch
from kvstrata.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents that aren't held out; documents in none of them (no text, no letter, too unlikely for each) go."""
    model = learn(docs.where(~held_out()).select("text", "lang"), floors=True)
    return identify(docs.select(*COLUMNS), model).where((F.col("lang_pred") != UND) & F.col("lang_fits")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that an earlier document's repeated sequence covers go; texts that lose none stay as they are, texts that lose all go."""
    cut = remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows, with the digest of their ids."""
    pieces = pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No stage but the second can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if hasattr(before, "kept_at"):
            scratch.drop(before)
    return docs
