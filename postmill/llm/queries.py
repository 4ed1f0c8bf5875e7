"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import collocations, decontaminate, html_cut, importance, line_dedup, mixing, pii, ppm, quality_rules, secret_scan, simhash, url_filters, warc
from postmill.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, d: quality_rules.op1(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "quality_rule_ablation": lambda spark, d: quality_rules.ablation_of(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op2_ppm": lambda spark, d: ppm.op2(documents(spark, d)),
    "op3_line_dedup": lambda spark, d: line_dedup.op3(documents(spark, d)),
    "op4_html_cut": lambda spark, d: html_cut.op4(spark.read.parquet(f"{d}/pages.parquet")),
    "op5_url_filters": url_filters.op5,
    "op6_decontaminate": lambda spark, d: decontaminate.op6(
        documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")
    ),
    "op7_pii": lambda spark, d: pii.op7(documents(spark, d)),
    "op8_simhash": lambda spark, d: simhash.op8(documents(spark, d)),
    "op9_mixing": lambda spark, d: mixing.op9(documents(spark, d)),
    "op10_warc": lambda spark, d: warc.op10(spark.read.parquet(f"{d}/pages.parquet")),
    "op11_secret_scan": lambda spark, d: secret_scan.op11(documents(spark, d)),
    "op12_resample": lambda spark, d: importance.op12(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op13_collocations": lambda spark, d: collocations.op13(documents(spark, d)),
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "quality_rule_ablation": quality_rules.ABLATION_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op5_url_filters": url_filters.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_resample": importance.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
