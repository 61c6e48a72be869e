"""From raw documents to packed token sequences, in five stages.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last
return the columns of ``documents``.

Null texts count as empty. Rows with a null id, null source or null language go through every stage like any
other; they are near copies of no document. Rows that repeat in every column are one document after the third
stage, and the mix may take a document up to three times. A very long text is one row until the last stage cuts
it into sequences. Ties are settled by the smallest id, or by a hash of the id in the mix. An empty table gives
an empty result. Extra columns are dropped on entry, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, table
from foliant.llm.linededup import WIDE, drop_boilerplate
from foliant.llm.mixing import mix_documents
from foliant.llm.nearcopies import joined_copies as near_duplicates
from foliant.llm.packing import pack_documents
from foliant.llm.quality import keep_quality, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays."""
    kept = drop_boilerplate(docs.select(*COLUMNS), wide=WIDE)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, and one row of it.

    A group is linked by Golay-code fuzzy hashing (fingerprints within 4 bits) or by sharing 0.8 of its five-word shingles.
    """
    groups = near_duplicates(docs)
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(keep, "doc_id", "left_semi")
    # Rows without an id belong to no group and stay; of rows that repeat in every column one stays.
    return kept.distinct().unionByName(docs.select(*COLUMNS).where(F.col("doc_id").isNull()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: SQL has no boosted model, fingerprint or token ids; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
