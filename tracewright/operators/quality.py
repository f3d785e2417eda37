"""Comparisons across recordings and across binary records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values


def presence_matrix(calls: DataFrame, few: int = 6) -> DataFrame:
    """Per call id the number of recordings that hold it, with its name and whether that is a small number."""
    pairs = calls.select("call_id", "trace_id").distinct()
    counts = pairs.groupBy("call_id").agg(F.count(F.lit(1)).alias("recordings"))
    names = F.broadcast(fixed_values.call_names(calls.sparkSession))
    unknown = F.concat(F.lit("**UNKNOWN("), F.col("call_id").cast("string"), F.lit(")**"))
    return counts.join(names, "call_id", "left").select(
        "call_id",
        F.coalesce("call_name", unknown).alias("call_name"),
        "recordings",
        (F.col("recordings") < few).alias("is_rare"),
    )


def presence_pairs(calls: DataFrame, few: int = 6) -> DataFrame:
    """Every call id with every recording that holds it, the number of those recordings, and whether that is small."""
    pairs = calls.select("call_id", "trace_id").distinct()
    counts = pairs.groupBy("call_id").agg(F.count(F.lit(1)).alias("recordings"))
    return pairs.join(counts, "call_id").select("call_id", "trace_id", "recordings", (F.col("recordings") < few).alias("is_rare"))


def byte_profile(records: DataFrame, group: str, column: str = "record") -> DataFrame:
    """Per group and byte offset that varies: the values with their counts and ranks, ties to the smaller byte.

    ``records`` is the number of non-empty records of the group. Bytes are counted per (group, offset, value), at most
    256 rows each, before anything is ranked.
    """
    kept = records.filter(F.length(column) > 0)
    sizes = kept.groupBy(group).agg(F.count(F.lit(1)).alias("records"))
    pairs = F.regexp_extract_all(F.lower(F.hex(column)), F.lit("(..)"), F.lit(1))
    counts = kept.select(group, F.posexplode(pairs).alias("offset", "byte")).groupBy(group, "offset", "byte").agg(F.count(F.lit(1)).alias("n"))
    rank = Window.partitionBy(group, "offset").orderBy(F.col("n").desc(), "byte")
    whole = Window.partitionBy(group, "offset")
    ranked = counts.select(
        "*", F.row_number().over(rank).alias("rank"), F.count(F.lit(1)).over(whole).alias("distinct_values")
    )
    varying = ranked.filter(F.col("distinct_values") > 1).join(sizes, group)
    return varying.select(group, "records", "offset", "distinct_values", "rank", F.concat(F.lit("0x"), "byte").alias("byte"), "n")
