"""Registered queries of this folder, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.check_sql import ORACLES as ORACLES
from metricloom.llm.decontamination import leak_report
from metricloom.llm.filter_audit import filter_interactions
from metricloom.llm.hard_negatives import hard_negatives
from metricloom.llm.language_model import scored_texts
from metricloom.llm.licenses import license_scan
from metricloom.llm.mixing import label_weights, mixed
from metricloom.llm.near_duplicates import near_duplicates
from metricloom.llm.packing_best_fit import packed_matrices
from metricloom.llm.packing_mixture import mixture_packed
from metricloom.llm.quality_rules import quality_verdicts
from metricloom.llm.repeats import repeat_report
from metricloom.llm.sharding import contiguous_shards
from metricloom.llm.token_counts import token_counts


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_matrices(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_read(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = quality_verdicts(_read(spark, folder, "documents"))
    return verdicts.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(_read(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(_read(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op8_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return contiguous_shards(_read(spark, folder, "documents"))


def op9_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = mixture_packed(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.drop("ids")


def op10_context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored_texts(_read(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, folder, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(_read(spark, folder, "documents"), label_weights(_read(spark, folder, "labels")))


def op13_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_interactions(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


QUERIES = {name: run for name, run in list(globals().items()) if name.startswith("op")}
