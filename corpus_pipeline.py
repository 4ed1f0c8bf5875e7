"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. No stage collects documents, and each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from postmill.llm.common import documents, spill

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, row: str, text: str) -> DataFrame:
    """The columns of ``row`` with another text, and the length that goes with it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    fields = docs.schema[row].dataType.fieldNames()
    return docs.select(*[new[c].alias(c) if c in new else F.col(row)[c].alias(c) for c in fields])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the current rule policy rejects."""
    lexicon = quality_rules.lexicon_of(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.filter_documents(docs, "v1", lexicon=lexicon)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three documents or more share; one document keeps them."""
    return _with_text(line_dedup.dedup_lines(docs), "row", "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate.contaminated_free(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, numbered by ``mix_copy``."""
    mixed = mixing.mix(docs, keep=[c for c in docs.columns if c != "mix_copy"])
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").select("row.*", copies.alias("mix_copy"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: Hamming components and the mixture's hash sums over them are beyond one SQL statement; the
#: stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
