"""Scalar expressions on times, shares and phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("CPU_BOUND", "GPU_BOUND", "BALANCED", "PIPELINE_BUBBLE", "IDLE")


def classify_phase(cpu: Column, gpu: Column) -> Column:
    return (
        F.when((cpu > 40) & (gpu < 20), "CPU_BOUND")
        .when((gpu > 40) & (cpu < 20), "GPU_BOUND")
        .when((cpu > 20) & (gpu > 20), "BALANCED")
        .when((cpu > 5) | (gpu > 5), "PIPELINE_BUBBLE")
        .otherwise("IDLE")
    )


def bucket_index(t: str, start: str, width: str) -> Column:
    return F.expr(f"({t} - {start}) div {width}")


def capped_percent(part: Column, whole: Column) -> Column:
    share = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, F.least(share, F.lit(100.0))).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def to_ms(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1e6)


def to_us(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1e3)


def edge_width(weight: Column) -> Column:
    return F.least(F.lit(1.0) + weight / F.lit(50.0), F.lit(5.0))


def node_width(count: Column, largest: Column) -> Column:
    return F.lit(1.5) + F.lit(2.5) * (count / F.greatest(largest, F.lit(1)))


def begin_key(ts: Column, idx: Column) -> Column:
    """One sortable number for (begin, index); a decimal keeps min_by/max_by in hash aggregation."""
    wide = ts.cast("decimal(38,0)") * F.lit(10**15).cast("decimal(16,0)")
    return wide.cast("decimal(38,0)") + idx.cast("decimal(20,0)")
