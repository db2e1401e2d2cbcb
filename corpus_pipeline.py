"""From raw documents to packed training sequences, each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. run() writes each stage's result as Parquet in the shared folder and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import op03_decontamination as decontamination
from tessella.llm import op04_packing as packing
from tessella.llm import op06_pii as pii
from tessella.llm import op07_order_minhash as order_minhash
from tessella.llm import op09_toxicity as toxicity
from tessella.llm.common import read, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't rate toxic; those without text stay."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.rate(docs, model).where("not toxic").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and all that are in none. Only
    the ids to drop meet the texts; they are broadcast up to a checked number."""
    found = order_minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = staged(found.where("not kept").select("doc_id").distinct(), "gone")
    small = gone.count() <= order_minhash.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontamination.decontaminate(docs.select(F.struct("*").alias("kept")).select("kept", "kept.text"), read(spark, sf_dir, "benchmark"), passed=["kept"])
    return found.where(F.size("hits") == 0).select("kept.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text."""
    found = pii.find(docs.select(F.struct("*").alias("kept"), "text"), ["kept"])
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("kept.text"), F.col("spans"))).otherwise(F.col("kept.text"))
    out = found.select("kept.*", text.alias("redacted_"))
    changed = {"text": F.col("redacted_")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("redacted_").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("redacted_").cast(kind))
    return out.select([changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the trained models, alignment or packing: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
