"""A training-data pipeline: each stage writes its documents, the next reads them.

Stages, in order: language identification (documents without a language go), near duplicates by
n-gram Jaccard join (one document of each group stays), benchmark decontamination (documents with
a benchmark passage go), mixing to target weights (documents are read as often as their rate says),
and token ids in directly addressable codes.

Each stage takes (spark, docs, sf_dir) and works on all the rows its predecessor kept; all but the
last return the columns of ``docs``. What a stage decides is defined for nulls, ties and empty
tables by its operator's docstring; rows with a null id go through each stage too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspan.llm import decontaminate, language_id, mixing, ngram_join, token_store
from trailspan.llm.common import scratch_path

#: Bytes of rows that go to a Python worker at a time. Workers live on from stage to stage, so their peaks stay: small ones matter.
BATCH_BYTES = 2 << 20

#: SQL can't express the classifiers and the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those with no letter at all, or null, are rejected."""
    _small_batches(spark)
    profiles = language_id.train_profiles(docs)
    found = language_id.identify(docs, profiles, pred_col="__lang", score_col="__score")
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") > 0)).drop("__lang", "__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked sets (5 words, 80 %), that with the smallest id; rows without words all stay.

    Rows with equal ids stay or go together; a row with a null id has no place among the ids and stays.
    """
    _small_batches(spark)
    found = ngram_join.similar_documents(docs, shingle=5, percent=80, flush_words=400_000, count=False, hub_list=32)
    # A group's name is its smallest id: every other id of the group goes.
    return ngram_join.without(docs, found.where("n_shingles > 0 and doc_id > component_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    found = decontaminate.with_flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__hit")
    return found.where("not __hit").drop("__hit")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: the whole part, and once more with the rest as probability.

    The choice is fixed by a hash of the id, so a second run keeps the same rows.
    """
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rates = mixing.mix(docs, labels).select("doc_id", "rate").where("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    times = rates.select("doc_id", copies.alias("__copies"))
    out = docs.join(times, "doc_id", "left").withColumn("__copies", F.coalesce("__copies", F.lit(1))).where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in shards, read back: doc_id, start, n_tokens, ids_crc32."""
    _small_batches(spark)
    folder = scratch_path(spark, "pipeline-tokens")
    token_store.write_tokens(docs, folder)
    return token_store.read_digests(spark, folder)


STAGES = [
    ("language_id", keep_languages),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{k}-{name}")
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
