"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

The quality classifier drops what it rejects; line dedup takes repeated lines out of the texts and drops
documents that lose all their lines; of each group of near copies one document stays; contaminated
documents go; the rest is packed into training windows. Documents without text pass up to the packing.

Defined results: rows without an id pass both dedup stages as they are; rows that repeat an id and its text are one document from
the third stage on, different texts of one id are documents of their own throughout; among near copies the lowest id stays, then
the lowest hash; texts of any length are read whole; further columns pass, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, kneser_ney, line_dedup, ngram_join, packing
from fleetlens.llm.common import land, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep_documents(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; ``n_chars`` follows the text."""
    # The report's names must not hide columns of the input.
    clash = {f.name.lower() for f in line_dedup.ADDED} & {c.lower() for c in docs.columns}
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in clash})
    done = line_dedup.dedup_lines(renamed).where("n_removed = 0 or trim(kept_text) <> ''")
    replaced = {"text": F.col("kept_text"), "n_chars": F.when(
        F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[replaced.get(c, F.col(f"`_own_{c}`" if c.lower() in clash else f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each group; rows that repeat an id and its text are one document.

    Different texts of one id are documents of their own. Rows without an id stay.
    """
    named = docs.where("doc_id is not null").withColumn("_node", F.xxhash64("doc_id", "text"))
    groups = land(ngram_join.link_documents(named, key="_node")).select(F.col("id").alias("_node"), "component_id")
    # Both aggregates fold equal rows before they are shuffled.
    first = named.select("_node", "doc_id").distinct().join(groups.distinct(), "_node").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_node"))["_node"].alias("_node"))
    one = named.join(first, "_node", "left_semi").groupBy("_node").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return one.select("_row.*").unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", pack),
]

#: Models, fuzzy links and retrieval have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs
