"""From raw documents to shards of a training mix: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lacuna.llm import bytecnn, hilbert, minmax, mixing, winnow
from lacuna.llm.texts import bitmap, with_passed, word_count
from lacuna.scratch import cut, cut_counted

#: A document stays with this quality score or more.
QUALITY = 0.3

#: Common shingles, in percent of all of two documents, that make them near duplicates.
SIMILARITY = 80

#: Weights of sources by name, repeated in turn, and how often a source may be repeated.
WEIGHTS, EPOCHS = [5, 2, 1], 3

SHARDS = 24


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject. Labels come from the folder's table. Rows are scored where
    they lie, so repeated rows and null ids are judged one by one."""
    net = bytecnn.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return bytecnn.with_score(docs, net, "__score").where(F.col("__score") >= QUALITY).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Documents without words are near no other; null ids
    come after all others; of repeated rows one stays; an empty table gives none."""
    return minmax.deduplicate(docs, percent=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item. The text alone decides, so the few texts that
    are hit are excluded by digest, whatever the ids of their rows. A filter of bounded size holds their digests; only texts that pass
    it are shuffled and meet the digests. Nulls are empty texts and stay, as do repeated rows that are clean; an
    empty table gives none; names beginning with two underscores are its own."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    found, _ = winnow.contamination(docs.select(digest.alias("__text"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__text")
    hit, seen = cut_counted(found.where(F.col("n_hit") > 0).select(F.col("id").alias("__text")).distinct(), "contaminated")
    pages, bits = bitmap(hit.select(F.xxhash64("__text").alias("hash")), "hash", seen["n"])
    passed = with_passed(docs.withColumn("__text", digest), F.xxhash64("__text"), cut(pages, "filter"), bits, "__passed")
    met = passed.where("__passed").join(hit, "__text", "left_anti").select(*docs.columns)
    return passed.where("NOT __passed").select(*docs.columns).unionByName(met)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix repeats it: a row per copy, none for a document that is left out. Repeated rows are decided
    one by one; documents without words weigh nothing; null sources are a source; an empty table gives none."""
    mixed = mixing.mix(docs, "doc_id", word_count(F.col("text")), "source", WEIGHTS, EPOCHS).where(F.col("mix.copies") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it, along a Hilbert curve through language, source and size. Ties are broken
    by a digest of the text, so no text is sampled, and then by id; a null text is empty, other nulls are the smallest; equal rows are
    interchangeable; an empty table gives none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({"__size": F.octet_length(text).cast("bigint"), "__digest": F.xxhash64(text)})
    return hilbert.hilbert_shards(sized, SHARDS, ["lang", "source"], ["__size"], ["__digest", "doc_id"]).drop("__size", "__digest")


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: Learned weights decide the first stage, so SQL cannot express the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
