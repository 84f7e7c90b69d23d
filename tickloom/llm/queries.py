"""Queries pN_ of the problems of training data over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.nearest import nearest_in_time
from tickloom.llm.packing import pack
from tickloom.llm.reading import reading_levels
from tickloom.llm.tokens import encode_corpus
from tickloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- 3 nearest in time
@query(
    "p3_found",
    """SELECT cand_id, arg_min(flash_id, (d, flash_id)) AS flash_id FROM (
  SELECT c.cand_id, f.flash_id, abs(c.t0 - (f.hit_time_range[1] / 16 - 5)) AS d
  FROM candidates c JOIN light_flash r ON r.light_id = c.light_id JOIN flash f ON f.flash_id = r.flash_id AND f.tpc = c.tpc
  WHERE c.light_id IS NOT NULL AND c.light_id <> -1 AND len(f.hit_time_range) > 0
    AND NOT list_contains(list_transform(f.hit_time_range, lambda x: x IS NULL OR isnan(x)), true))
WHERE d <= 5 GROUP BY cand_id""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    span = F.col("hit_time_range")
    whole = (F.size(span) > 0) & ~F.exists(span, lambda x: x.isNull() | F.isnan(x))
    flash = table(spark, d, "flash").where(whole).select("flash_id", "tpc", (F.get(span, F.lit(0)) / 16 - 5).alias("t")).distinct()
    linked = table(spark, d, "light_flash").where("light_id IS NOT NULL AND light_id <> -1").select("light_id", "flash_id").distinct().join(flash, "flash_id")
    found = nearest_in_time(
        table(spark, d, "candidates").where("light_id <> -1"), linked, ["light_id", "tpc"], 5.0, "cand_id", "flash_id", F.col("t0"), F.col("t")
    )
    return found.select(F.col("left_id").alias("cand_id"), F.col("right_id").alias("flash_id"))


# ---------------------------------------------------------------- 7 encoding
@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


# ---------------------------------------------------------------- 8 containers
CAPACITY = 2048


@query("p8_pack")
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode_corpus(table(spark, d, "documents"), count_only=True)
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest that could do, and the share of room left over."""
    filled = p8_pack(spark, d).groupBy("container_id").agg(F.sum("length").alias("used"))
    return filled.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / CAPACITY).alias("least"),
        F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("slack_share"),
    )


# ---------------------------------------------------------------- 9 reading level
@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "band")


@query("p9_profile")
def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean level by source and band."""
    docs = table(spark, d, "documents")
    levels = reading_levels(docs, table(spark, d, "reading_labels"))
    return levels.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("level"), 4).alias("mean_level")
    )
