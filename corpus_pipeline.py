"""A corpus pipeline of five stages, each an operator of lithic.llm over all that its predecessor kept.

Every stage but the last takes and returns the columns of documents. Documents that the classifier rejects go; of each
group of near duplicates one stays; repeated passages are cut out of texts; documents that hold benchmark passages go;
what is left is encoded into pieces, and decoded again to prove that nothing is lost.

Cases, for every stage: further columns, whatever they are called, are carried along; an empty table stays empty; a null
text counts as an empty one, but stays null; texts of any length are taken whole; rows that share an id are rows of their
own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import table
from lithic.llm.decontaminate import decontaminate
from lithic.llm.nearcopies import first_of_alike
from lithic.llm.passages import remove_passages
from lithic.llm.quality import THRESHOLD, score_quality, train
from lithic.llm.sentencepieces import encode_decode


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay. Null and empty texts are scored like any other, repeated rows
    alike, and a score at the threshold stays; without labels of both kinds all have the labels' mean."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("score") >= THRESHOLD).select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are alike (Jaccard 0.8 or more), the document with the least id
    stays. Null and empty texts are one component; of repeated rows one stays, and of texts with one id that are unlike,
    each; a null id comes last. Links are those of operator 9's fingerprints, confirmed, and all that they can't see."""
    return first_of_alike(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut out; documents stay, with the words that are left, and n_chars follows. Null and
    empty texts stay as they are; of repeated rows with a passage none keeps it; a text that nothing is cut from keeps its
    white space."""
    found = remove_passages(docs)
    new = {"text": F.col("m.kept"), "n_chars": F.when(F.col("m.n_removed") > 0, F.length("m.kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, repeated rows alike; null and empty texts hold none and stay. Without a
    benchmark all stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("m.items") == 0).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back: null for a null text, no ids for an empty one."""
    found = encode_decode(docs.select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", F.size("m.ids").cast("long").alias("n_tokens"), F.col("m.ids").alias("ids"), "m.round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has no trees, automata or pieces; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
