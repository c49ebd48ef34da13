"""The corpus pipeline: quality rules, quality classifier, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. ``run`` chains the stages on the whole table; between stages it cuts the lineage in the
shared checkpoint folder, as a reader of written stages would find them.

Cases defined for all stages: an empty table gives an empty table; further columns are kept by all stages but the
last, whatever their names; texts of any length are worked on whole; repeated rows are rows of their own until
near-dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import mixing, quality_rules, ranking, simhash, spm
from sievewright.llm.common import cut_lineage, prepare, read


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are outliers of their language and source, go.

    NULL and blank texts fail the base rule; NULL languages and sources are groups of their own; NULL ids stay.
    """
    prepare(spark)
    return quality_rules.filter_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. The ranking is learnt from the labelled rows of the raw table.

    NULL texts score as empty ones; equal texts score equally; without labels of both classes every score is 0.5,
    and all documents stay.
    """
    prepare(spark)
    model = ranking.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return ranking.filter_documents(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that with the smallest id.

    NULL and blank texts are one group; of rows whose ids are NULL or repeated the one with the smallest columns
    stays, where no row with a plain id is in the group.
    """
    prepare(spark)
    return simhash.dedup_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole copies, then the copy that the budget cuts.

    NULL and blank texts have no words and are never taken; NULL sources are one source; rows of one id are taken
    in order of their sizes.
    """
    return mixing.mix_documents(docs)


def tokenising_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as ids, with the number of tokens and whether decoding gives the text back.

    A NULL text has NULL ids, no tokens and counts as given back; an empty one has no ids. Further columns are ignored.
    """
    prepare(spark)
    done = spm.round_trip(docs)
    same = F.coalesce(F.translate("text", spm.MARK, " ") == F.col("decoded"), F.col("text").isNull())
    return done.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokenising", tokenising_stage),
]

#: Neither the rules' estimates nor the classifier are expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
