"""Catalog and generic tables: recording facts, table lists, reference expansion, typed and generic reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import text
from tracewright.operators.ordered import index_chunk, number_rows
from tracewright.session import cut_lineage


def trace_info(df: DataFrame) -> DataFrame:
    """One row per recording; missing texts read as empty, a missing length as 0."""
    optional = ("target_process", "target_pid")
    texts = [c for c, t in df.dtypes if t == "string" and c not in (*optional, "trace_id")]
    return df.na.fill("", texts).na.fill(0.0, ["duration_seconds"])


def list_tables(df: DataFrame) -> DataFrame:
    """Every table entry of every recording, duplicates kept, attributes without the schema name."""
    return df.select("trace_id", "ord", "schema", F.map_filter("attributes", lambda k, _: k != "schema").alias("attributes"))


def has_table(df: DataFrame, schema: str) -> DataFrame:
    """Recordings and whether they hold the table."""
    return df.groupBy("trace_id").agg(F.max(F.col("schema") == schema).alias("has_table"))


def processes(df: DataFrame, distinct: bool = False) -> DataFrame:
    """Process entries in file order; the target is listed twice unless ``distinct``."""
    filled = df.select("trace_id", "ord", F.coalesce("pid", F.lit(0)).alias("pid"), F.coalesce("name", F.lit("")).alias("name"))
    return filled.select("trace_id", "pid", "name").distinct() if distinct else filled


def open_trace(info: DataFrame, tables: DataFrame, entries: DataFrame) -> DataFrame:
    """Recording facts with the different names of its tables, the number of its tables and of its process entries."""
    # The names come from the recording format, so a set of them is short however many tables there are.
    named = tables.groupBy("trace_id").agg(F.sort_array(F.collect_set("schema")).alias("tables"), F.count(F.lit(1)).alias("num_tables"))
    counted = entries.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_processes"))
    return trace_info(info).join(named, "trace_id", "left").join(counted, "trace_id", "left")


def expand_refs(
    elements: DataFrame, keys: list[str], content: list[str], id_column: str = "id", ref_column: str = "ref", order: str | Column | None = None
) -> DataFrame:
    """Elements with ``ref`` take the content of the element with that id in the same document.

    Chains of any length are followed by doubling the id map until no link moves; the rounds grow with the logarithm of
    the longest chain. References that run in a circle or to an unknown id keep their own (empty) content. Of several
    elements with one id the last by ``order`` counts, any one of them without it.
    """
    named = elements.filter(F.col(id_column).isNotNull())
    if order is None:
        named = named.dropDuplicates([*keys, id_column])
    else:
        last = F.max_by(F.struct(ref_column, *content), order).alias("_last")
        named = named.groupBy(*keys, id_column).agg(last).select(*keys, id_column, "_last.*")
    links = cut_lineage(
        named.filter(F.col(ref_column).isNotNull()).select(*keys, F.col(id_column).alias("_from"), F.col(ref_column).alias("_to"))
    )
    moved = None
    while True:
        onward = links.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        step = links.join(onward, [*keys, "_to"], "left")
        before, moved = moved, step.filter("_next is not null").count()
        # Every round settles some links of each open chain, so a number that stays is that of the circles.
        if not moved or moved == before:
            break
        links = cut_lineage(step.select(*keys, "_from", F.coalesce("_next", "_to").alias("_to")))
    rows = elements.join(links.withColumnRenamed("_from", ref_column), [*keys, ref_column], "left")
    rows = rows.withColumn("_goal", F.coalesce("_to", ref_column)).drop("_to")
    source = named.filter(F.col(ref_column).isNull()).select(
        *keys, F.col(id_column).alias("_goal"), *[F.col(c).alias(f"_{c}") for c in content], F.lit(True).alias("_found")
    )
    joined = rows.join(source, [*keys, "_goal"], "left")
    taken = {c: F.when(F.col("_found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in content}
    return joined.select(*[taken.get(c, F.col(c)).alias(c) for c in elements.columns])


def typed(cells: DataFrame) -> DataFrame:
    """Display and integer value of each cell; placeholders of missing cells are null."""
    missing = F.col("tag") == "sentinel"
    return cells.select(
        "*",
        F.when(~missing, text.display_value(F.col("fmt"), F.col("text"))).alias("value"),
        F.when(~missing, text.int_value(F.col("text"))).alias("int_value"),
    )


def query_table(cells: DataFrame, schema: str, limit: int | None = None) -> DataFrame:
    """Any table by name: one row per table row with mnemonic → display text, the total and the number returned.

    Row numbers are dense per recording, so the limit is a filter. Cells without a header are left out, and the first of
    several columns with one mnemonic counts. A name that no recording has is an error that names the tables there are.
    """
    checks.limit_offset(limit)
    chosen = cells.filter(F.col("schema") == checks.filled("schema", schema))
    if chosen.isEmpty():
        # Table names come from the recording format, so they are few.
        names = sorted(r["schema"] for r in cells.select("schema").distinct().collect() if r["schema"])
        raise ValueError(f"no table {schema!r}; there are: {', '.join(names) or 'none'}")
    shown = text.display_value(F.col("fmt"), F.col("text"))
    firsts = chosen.filter("mnemonic is not null").groupBy("trace_id", "row_no", "mnemonic").agg(F.min_by(shown, "position").alias("shown"))
    filled = firsts.groupBy("trace_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("mnemonic", "shown"))).alias("row"))
    totals = chosen.groupBy("trace_id").agg(F.count_distinct("row_no").alias("total_rows"))
    rows = chosen.select("trace_id", "row_no").distinct().join(filled, ["trace_id", "row_no"], "left")
    if limit is not None:
        rows = number_rows(cut_lineage(rows), ["trace_id"], "row_no", "_r", index_chunk("row_no")).filter(F.col("_r") < limit).drop("_r")
    returned = F.least("total_rows", F.lit(limit)) if limit is not None else F.col("total_rows")
    return rows.join(totals.withColumn("returned_rows", returned), "trace_id")


def table_columns(columns: DataFrame, schema: str) -> DataFrame:
    """Column definitions of a table in order, as its header gives them; those without a mnemonic are left out."""
    chosen = columns.filter((F.col("schema") == checks.filled("schema", schema)) & F.col("mnemonic").isNotNull())
    return chosen.select("trace_id", "position", "mnemonic", "name", "engineering_type")


def available_tables(cells: DataFrame) -> DataFrame:
    """Names of the tables that can be queried, per recording."""
    return cells.select("trace_id", "schema").distinct()
