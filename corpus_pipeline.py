"""A training corpus from raw documents, as stages that each call one operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, language_id, minhash_dedup, mixing, queries, sharding, store

#: Stages on word shingles: five words, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


#: A prediction at least this sure wins over the language that a document was declared to have.
SURE = 0.9
#: Row numbers up to this many are broadcast to drop rows (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any text in a language (null, blank, or without a letter). lang becomes the predicted language where none was declared or the prediction is sure."""
    packed = docs.select("doc_id", "text", "lang", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    found = language_id.identify(packed, carry=["row", "text"]).where("lang_pred <> 'und'")
    lang = F.when(F.col("row.lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("row.lang"))
    return found.select(*[lang.alias(c) if c == "lang" else F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose number isn't in column n of gone, as they came."""
    gone = store.Work(rows.sparkSession, name).save(gone.select("n").distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(few, "n", "left_anti").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id (null last), of several the first. Rows without words are in no group."""
    rows = store.numbered(docs, store.Work(spark, "near"))
    texts = rows.select("n", F.col("row.text").alias("text"))
    found = minhash_dedup.near_duplicates(texts, doc_id="n", width=SHINGLE_WORDS, similarity=SIMILARITY)
    grouped = found.join(found.where("NOT kept").select("component_id").distinct(), "component_id")
    named = grouped.select("component_id", F.col("doc_id").alias("n")).join(rows.select("n", F.col("row.doc_id").alias("id")), "n")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    stays = named.groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least.n").alias("n"))
    return without(rows, named.join(stays, "n", "left_anti"), "near-gone")


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, edited or not, of a benchmark item."""
    rows = store.numbered(docs, store.Work(spark, "leaks"))
    leaks = decontaminate.find_leaks(rows.select("n", F.col("row.text").alias("text")), queries.read(spark, sf_dir, "benchmark"), doc_id="n")
    return without(rows, leaks.select(F.col("doc_id").alias("n")), "leaks-gone")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: every document once, those of lighter sources again until the heaviest one is through."""
    return mixing.mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the new shards; the size, checksum, shard and slot of every row as the files have them."""
    return sharding.reshard_files(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", near_dedup),
    ("decontaminate", remove_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    work = store.Work(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None
