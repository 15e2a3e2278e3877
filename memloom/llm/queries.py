"""The operators' queries over the driver's tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, importance, langid, lexical_search, licenses, minhash, mixing, quality_rules, token_counts, toxicity, url_filters
from .common import documents, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), with_ids=False)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An index of its own that starts empty: the table goes in as four parts, and three of them meet what the earlier ones left.
    index = exact_dedup.DigestIndex.temporary(spark, "op9_digests")
    found = exact_dedup.exact_dedup(documents(spark, sf_dir), index, parts=4)
    index.drop()
    return found


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_importance_resampling, op4_license_scan, op5_minhash_dedup, op6_token_counts, op7_toxicity, op8_language_id, op9_exact_dedup, op10_mixing, op11_url_filter, op12_centroid_clustering, op13_lexical_search)}

ORACLES = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op4_license_scan": licenses.oracle_sql(),
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_url_filter": url_filters.ORACLE_SQL,
    "op12_centroid_clustering": centroids.oracle_sql(),
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
