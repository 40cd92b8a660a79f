"""Ranks and running totals that never put a whole table, or a whole hot group, in one task.

Three ways, by what the order is made of:

* hash order (``seeded_*``): md5 keys are uniform, so the leading hex digits cut every group, hot
  or not, into equal slices;
* value order with totals (``running_totals``): rows collapse to distinct values first, then a
  range layout cuts the values into as many parts as their number calls for;
* row order with ties (``global_row_number``): Spark's range partitioner over the full sort key,
  written once so that both readers of the layout see the same one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecrest.session import cut_lineage

HASH_DIGITS = 4
RANGE_ROWS = 1 << 20  # rows a task of a range layout should hold


def seeded_key(id_col: str | Column, seed: int) -> Column:
    """md5 of ``seed:id``; the order that stands in for every seeded shuffle."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def seeded_row_number(
    df: DataFrame,
    id_col: str,
    seed: int,
    by: Sequence[str] = (),
    name: str = "rn",
    size_name: str | None = None,
) -> DataFrame:
    """1-based position of each row in md5 order inside ``by``.

    Position = rows in earlier hash slices of the group (a table of at most 16^4 rows a group) +
    row number inside the slice, so a group that holds a third of all rows is still 65,536 tasks'
    worth of work. ``size_name`` adds the group size at no extra shuffle.
    """
    by = list(by)
    keyed = df.withColumn("_key", seeded_key(id_col, seed)).withColumn("_slice", F.substring("_key", 1, HASH_DIGITS))
    per_slice = keyed.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_slice.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_oslice"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_gsize"),
    )
    on = F.col("_slice") == F.col("_oslice")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_key", id_col)
    out = (
        keyed.withColumn("_in", F.row_number().over(inside))
        .join(offsets, on)
        .withColumn(name, F.col("_offset") + F.col("_in"))
    )
    if size_name:
        out = out.withColumn(size_name, F.col("_gsize"))
    return out.drop("_key", "_slice", "_in", "_oslice", "_offset", "_gsize", *[f"_g{i}" for i in range(len(by))])


def range_layout(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``rows`` (a written table) cut into ranges of ``keys`` by Spark's range partitioner, with ``_part``.

    There are as many ranges as shuffle partitions, or as rows call for if these are more. The layout
    is written, so that all its readers see the same one.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    return cut_lineage(rows.repartitionByRange(parts, *keys).select("*", F.spark_partition_id().alias("_part")))


def _with_earlier(laid: DataFrame, by: Sequence[str], found: dict) -> DataFrame:
    """Attach to each row what the ranges before its own amount to inside ``by``: name -> (aggregate, fold of aggregates)."""
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = laid.groupBy(*by, "_part").agg(*[agg.alias(f"_a_{name}") for name, (agg, _) in found.items()])
    shifts = per_part.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.col("_part").alias("_opart"),
        *[fold(F.col(f"_a_{name}")).over(before).alias(name) for name, (_, fold) in found.items()],
    )
    on = F.col("_part") == F.col("_opart")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return laid.join(shifts, on).drop("_opart", *[f"_g{i}" for i in range(len(by))])


def running_totals(
    cells: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = (), descending: bool = True, prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running sums of ``totals`` in ``value`` order inside ``by``.

    ``cells`` is a written table with one row per (by, value). It is laid out in ranges of
    (by, value); each range is summed on its own and shifted by the totals of the ranges before it.
    """
    by = list(by)
    value_order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    laid = range_layout(cells, [*[F.col(c).asc_nulls_first() for c in by], value_order])
    shifted = _with_earlier(laid, by, {f"_o{i}": (F.sum(t), F.sum) for i, t in enumerate(totals)})
    inside = Window.partitionBy(*by, "_part").orderBy(value_order).rowsBetween(Window.unboundedPreceding, 0)
    return shifted.select(
        *cells.columns,
        *[(F.sum(t).over(inside) + F.coalesce(F.col(f"_o{i}"), F.lit(0))).alias(prefix + t) for i, t in enumerate(totals)],
    )


def running_max(df: DataFrame, order: str, value: str, by: Sequence[str] = (), name: str = "best_before") -> DataFrame:
    """Largest ``value`` of the rows before each row, in (unique) ``order`` inside ``by``; ``df`` is a written table.

    Laid out in ranges of (by, order) like ``running_totals``, so a group that holds a third of the
    rows is not one window.
    """
    by = list(by)
    laid = range_layout(df, [*[F.col(c).asc_nulls_first() for c in by], F.col(order).asc_nulls_first()])
    shifted = _with_earlier(laid, by, {"_earlier": (F.max(value), F.max)})
    inside = Window.partitionBy(*by, "_part").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return shifted.select(*df.columns, F.greatest(F.max(value).over(inside), "_earlier").alias(name))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, id_col: str, name: str = "rank", salts: int = 256) -> DataFrame:
    """First ``n`` rows per group with their rank, one way for every ``n``.

    Groups are first cut to ``n`` inside hash salts of the id, then inside the group, so no task ever
    sorts a whole hot group: its last task gets at most ``n`` rows a salt.
    """
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts))).withColumn("_pre", F.row_number().over(part))
    rows = salted.where(F.col("_pre") <= n).drop("_salt", "_pre")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str = "rn", by: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Unique 1-based ranks in ``order`` (inside ``by``) over a range-partitioned layout.

    The range key is the whole sort key, ties included, so one value shared by a third of the rows
    is spread over many partitions. The layout is written once: partition counts and rows must
    come from the same one.
    """
    by = list(by)
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    laid_out = (
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    )
    laid_out = cut_lineage(laid_out)
    laid_out = laid_out.withColumn("_part", F.shiftright("_m", 33)).withColumn("_pos", F.col("_m").bitwiseAND((1 << 33) - 1))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid_out.groupBy(*by, "_part")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
            F.col("_part").alias("_opart"),
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    on = F.col("_part") == F.col("_opart")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        laid_out.join(starts, on)
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_offset") + 1)
        .drop("_m", "_part", "_pos", "_opart", "_first", "_offset", *[f"_g{i}" for i in range(len(by))])
    )


def average_ranks(df: DataFrame, ranks: dict[str, str], pct: bool = False, ascending: bool = True) -> DataFrame:
    """Tie-averaged ranks of several columns (value -> rank name), NULLs last, optionally over the row count.

    Ranks belong to values: each column's distinct values are ranked from the input itself, so no
    rank is computed on top of another one's joins, and then joined back.
    """
    values = list(ranks)
    size = df.agg(F.struct(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"k{i}") for i, v in enumerate(values)])).scalar()
    out = df.withColumn("_size", size)
    for i, v in enumerate(values):
        cells = cut_lineage(df.where(F.col(v).isNotNull()).groupBy(v).agg(F.count(F.lit(1)).alias("_c")))
        ranked = running_totals(cells, v, ["_c"], descending=not ascending).select(
            F.col(v).alias(f"_v{i}"), (F.col("cum__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias(f"_r{i}")
        )
        out = out.join(ranked, F.col(v) == F.col(f"_v{i}"), "left")
    picked = []
    for i, v in enumerate(values):
        rank = F.coalesce(F.col(f"_r{i}"), (F.col(f"_size.k{i}") + 1 + F.col("_size.n")) / 2)
        picked.append((rank / F.col("_size.n") if pct else rank).alias(ranks[v]))
    return out.select(*df.columns, *picked)


def average_rank(df: DataFrame, value: str, name: str = "avg_rank", pct: bool = False, ascending: bool = True) -> DataFrame:
    """``average_ranks`` of one column."""
    return average_ranks(df, {value: name}, pct, ascending)


def sorted_rows(df: DataFrame, spec: Sequence[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Sort by (column, 'asc' or 'desc') pairs with NULLs last; with a limit it is a distributed top-n."""
    order = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in spec]
    out = df.orderBy(*order)
    return out.limit(limit) if limit is not None else out
