"""Registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (ann_search, centroid_clusters, classify, hard_negatives, html_extract,
               mixing, packing, personal_data, secret_scan, simhash_dedup, statements, topk_search, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {
    "op1_secret_scan": statements.SECRETS, "op10_maxscore_topk": statements.TOP_K,
    "op12_centroid_clusters": statements.CLUSTERS, "op13_hard_negatives": statements.HARD_NEGATIVES,
}


def registered(key: str):
    def register(query):
        QUERIES[key] = query
        return query

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@registered("op1_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, folder, "documents"))


@registered("op2_mix_sources")
def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, folder, "documents"))


@registered("op3_url_filter")
def urls(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


@registered("op4_html_extract")
def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(_table(spark, folder, "pages"))


@registered("op5_language_id")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return classify.identify(docs, classify.language_model(docs))


@registered("op6_simhash_dedup")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, folder, "documents"))


@registered("op7_quality_classifier")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return classify.quality_scores(docs, classify.quality_model(docs, _table(spark, folder, "labels")))


@registered("op8_pack_sequences")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@registered("op9_learned_partitions")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann_search.nearest(_table(spark, folder, "embeddings"))


@registered("op10_maxscore_topk")
def top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_k(_table(spark, folder, "embeddings"))


@registered("op11_personal_data")
def personal(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return personal_data.report(docs, personal_data.fitted(docs))


@registered("op12_centroid_clusters")
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters.report(_table(spark, folder, "embeddings"))


@registered("op13_hard_negatives")
def hard_negatives_of(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, folder, "embeddings"), relabel=hard_negatives.next_of_ten)
