"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import oracle
from tidewrack.llm.blocks import page_furniture
from tidewrack.llm.history import seen_pages
from tidewrack.llm.leakage import leaked_items
from tidewrack.llm.mailspans import unauthored_lines
from tidewrack.llm.mixing import mix_sources, reached_shares, share_bounds
from tidewrack.llm.residue import residue_of
from tidewrack.llm.subjects import document_subjects
from tidewrack.llm.variants import similar_pairs
from tidewrack.tables import table


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return residue_of(table(spark, data_dir, "items"), table(spark, data_dir, "feed_results"))


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return page_furniture(table(spark, data_dir, "items"), table(spark, data_dir, "messages"))


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return unauthored_lines(table(spark, data_dir, "messages"))


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return similar_pairs(table(spark, data_dir, "items"))


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return seen_pages(table(spark, data_dir, "items"), table(spark, data_dir, "feed_results"))


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return leaked_items(table(spark, data_dir, "documents"), table(spark, data_dir, "eval_items"))


def p9_mixture(spark: SparkSession, data_dir: str) -> DataFrame:
    return mix_sources(table(spark, data_dir, "documents"), table(spark, data_dir, "mix_targets"))


def p9_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    docs, targets = table(spark, data_dir, "documents"), table(spark, data_dir, "mix_targets")
    return reached_shares(mix_sources(docs, targets), docs, targets)


def p9_bounds(spark: SparkSession, data_dir: str) -> DataFrame:
    docs, targets = table(spark, data_dir, "documents"), table(spark, data_dir, "mix_targets")
    return share_bounds(mix_sources(docs, targets), docs, targets)


def p10_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return document_subjects(*(table(spark, data_dir, t) for t in ("documents", "doc_labels", "subjects")))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p8_found": p8_found,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_bounds": p9_bounds,
    "p10_found": p10_found,
}

ORACLE = {"p4_found": oracle.P4, "p5_found": oracle.P5, "p8_found": oracle.P8, "p9_bounds": "SELECT source, TRUE AS within_cap, TRUE AS on_target FROM mix_targets"}
