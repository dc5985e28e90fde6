"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Defined results: an empty table passes through; documents keep their columns, whatever else these are and whatever their
names, up to the last stage, which returns a digest of the encoded text and its place in the order of the files that the
mixing stage wrote, sorted by it.
Null and empty texts count as texts without words: the near-dedup keeps one of them all. Documents that line dedup leaves
empty go. A null id sorts before others in line dedup and goes first of its class in near-dedup if the class has no id; a
null source is one of its own. Of repeated rows, and of ties in text, one stays. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farside.llm import bpe, lines, mixing, simhash, toxicity
from farside.llm.util import column_name, discard, stash


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not find toxic."""
    source, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.screen(docs, toxicity.train(source, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus, and none that has nothing left; n_chars follows the text."""
    out = lines.dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: by SimHash, and by a Jaccard similarity of 0.8 of sets of five words."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order that interleaves their sources by weight."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, with each row's place in the mixed order, which is that of the
    files of the stage before and of their rows."""
    position = column_name(docs, "position")
    # stored, as an order by ranges reads its input twice
    rows = stash(bpe.digest(mixing.in_order(docs, position), bpe.default_tokenizer(), keep=("doc_id", "source", position)))
    return rows.withColumnRenamed(position, "position").orderBy("position")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the trained classifier; tests hold the run against a slow version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
