"""From raw documents to token ids: five stages over the operators of ``paceline.llm``.

Each stage takes the documents its predecessor kept; all but the last return them with
the columns of ``documents``.  ``run`` writes each stage's result as Parquet in the
shared folder and rereads it, so a lost executor repeats a stage's last step at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import bpe, decontam, langid, minhash, suffixes
from paceline.plans.tables import materialize, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# SQL has neither the trained network nor the tokenizer.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any language: null texts and texts without a letter.

    With no labelled document there is nothing to learn from; letters alone decide then.
    """
    network = langid.learn(docs)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    scored = langid.predict(docs, network, carry=COLUMNS[1:])
    return scored.where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that of the smallest ``doc_id``.

    Where ids are repeated, rows are numbered and judged by their number, so different
    texts under one id are different documents; of a group's rows the one with the
    smallest id, then number, stays.  Null ids and texts without a word are in no group.
    """
    named = docs.where("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = _keep(docs, "doc_id", minhash.near_duplicates(named).where("kept"))
        return kept.union(docs.where("doc_id IS NULL").select(*COLUMNS))
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    named = numbered.where("doc_id IS NOT NULL")
    found = minhash.near_duplicates(named.select(F.col("_row").alias("doc_id"), "text"))
    found = found.withColumnRenamed("doc_id", "_row").join(named.select("_row", "doc_id"), "_row")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("f")).select("f._row")
    return _keep(numbered, "_row", first).union(numbered.where("doc_id IS NULL").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that start earlier as well out of the texts."""
    cut = suffixes.repeated_spans(docs, with_text=True, carry=["lang", "source"])
    out = cut.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return out.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark windows in at least one word of twenty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontam.contamination(docs, benchmark, carry=COLUMNS[1:])
    return judged.where("NOT contaminated").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, and digests of ids and decoded texts."""
    import public_tokenizers

    ids = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.drop("decoded")


def _keep(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key``, never null, is among ``kept``."""
    return docs.join(kept.select(key), key, "left_semi").select(*COLUMNS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
