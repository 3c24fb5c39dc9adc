"""Corpus pipeline over `documents`: toxicity, quality, exact dedup, near dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.

Edge cases, for every stage: null and empty texts are scored, compared and packed like any other; very long texts are read whole; rows with a
null or repeated identifier are told apart by their text, so unlike texts stay and of equal rows one stays; other columns, whatever
their names, are carried along; an empty table gives an empty result; without labels both classifiers score all texts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, packing, quality, simhash, toxicity
from spanloom.llm.common import written


def _name(digest: Column) -> Column:
    """What tells rows apart: the digest of the text, of fixed length, and the identifier, which may be null."""
    return F.concat_ws(" ", digest, F.col("doc_id").cast("string"))


def _kept(docs: DataFrame, digest: Column, keep: DataFrame) -> DataFrame:
    """Rows of docs that keep (doc_id, text_sha256) names, with docs' own columns; of rows with one name that whose other columns
    come first as JSON stays, so a column needs no order of its own. Rows are combined before they are dealt out, so many copies under one identifier don't meet in one task."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(_name(digest).alias("name"), rank.alias("rank"), F.struct("*").alias("row")).groupBy("name").agg(F.min_by("row", "rank").alias("row"))
    return rows.join(keep.select(_name(F.col("text_sha256")).alias("name")), "name", "left_semi").select("row.*")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.score_column(spark, scorer)(F.col("text")) < toxicity.THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(docs, _labels(spark, sf_dir))
    return docs.where(quality.score_column(spark, weights)(F.col("text")) >= quality.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, F.sha2(exact_dedup.normalised(F.col("text")), 256), exact_dedup.exact_dedup(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, F.sha2(F.coalesce("text", F.lit("")), 256), simhash.near_kept(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

#: SQL can't express the learned weights, fingerprints and token ids; tests check the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
