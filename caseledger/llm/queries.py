"""The registered queries of the training-data operators and the SQL they equal."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_links import linked
from .hard_negatives import hard_negatives
from .importance import resampled
from .licenses import known_licenses, license_scan
from .line_rules import quality_rules
from .mixing import mix
from .near_duplicates import near_duplicates
from .packing import packed
from .pairwise_quality import quality_scores
from .placement import placed
from .secrets import secret_digests
from .shared import new_path, prepare, stored
from .sql import ORACLES
from .token_rollups import Rollup, counted, revised, signed
from .warc import derived, responses

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(_table(spark, sf_dir, "documents")).rows
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), known_licenses(spark))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derived(responses(_table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", F.md5("header").alias("header_md5"),
        F.md5("block").alias("block_md5"), F.length("block").alias("block_chars"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(_table(spark, sf_dir, "embeddings"))


def op5_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on one of 64 shards."""
    shards = [f"shard-{k:03d}" for k in range(64)]
    return placed(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", shards)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, recount German by a second vocabulary, withdraw repeated texts; one batch is sent twice."""
    docs = _table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", F.md5("text").alias("digest")).filter("digest IS NOT NULL")
    # Stored, so that the rows of a text with very many copies can be split in the join.
    first = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("first")), "first-copies")
    again = keyed.join(first, "digest").filter("doc_id <> first").select(F.col("doc_id").alias("id"))
    one, two = "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup = Rollup(spark, new_path(spark, "rollup"))
    first = stored(counted(docs, one), "counts")
    rollup.commit("load", signed(first, 1))
    german = stored(counted(docs.filter("lang = 'de'"), two), "counts")
    recount = revised(first.filter("lang = 'de'"), german)
    rollup.commit("recount", recount)
    rollup.commit("recount", recount)
    now = first.filter("lang IS NULL OR lang <> 'de'").unionByName(german)
    rollup.commit("withdraw", signed(now.join(again, "id", "left_semi"), -1))
    return rollup.totals()


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumn("clean_md5", F.md5(F.col("clean_text").cast("binary"))).drop("clean_text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50. Ids divisible by 7 move to the next of ten labels first."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_license_scan, op3_warc_derivatives, op4_embedding_near_dedup, op5_shard_placement,
        op6_best_fit_packing, op7_minhash_near_dedup, op8_token_rollups, op9_quality_rules, op10_quality_classifier,
        op11_hard_negatives, op12_importance_resampling, op13_secret_scan,
    )
}
