"""Running sums in two levels: within ranges of the order column and over the ranges' totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antecede.sources.tables import stored


def marks(rows: DataFrame, order: str) -> list[float]:
    """Up to 63 cuts of the order column into ranges of about equal size."""
    found = rows.agg(F.percentile_approx(order, [k / 64 for k in range(1, 64)], 2000)).first()[0] or []
    return sorted({float(m) for m in found})


def placed(rows: DataFrame, order: str, cuts: list[float]) -> DataFrame:
    """rows with _range, the number of cuts below the order column."""
    held = F.array(*[F.lit(m) for m in cuts]) if cuts else F.array().cast("array<double>")
    return rows.withColumn("_range", F.size(F.filter(held, lambda m: m < F.col(order).cast("double"))))


def sums(rows: DataFrame, order: str, columns: dict[str, str], descending: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of columns (name -> new name) of placed() rows, which are read twice."""
    by = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    inner = Window.partitionBy(*keys, "_range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    outer = Window.partitionBy(*keys).orderBy(by("_range")).rowsBetween(Window.unboundedPreceding, -1)  # 64 rows for each key
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(outer), F.lit(0)).alias(f"_{c}") for c in columns])
    summed = rows.select("*", *[F.sum(c).over(inner).alias(f"_in_{c}") for c in columns]).join(F.broadcast(totals), [*keys, "_range"])
    kept = [c for c in rows.columns if c != "_range"]
    return summed.select(*kept, *[(F.col(f"_in_{c}") + F.col(f"_{c}")).alias(new) for c, new in columns.items()])


def running(rows: DataFrame, order: str, columns: dict[str, str], descending: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of columns (name -> new name) by order within keys, so that no task holds the whole table. order:
    distinct within keys."""
    rows = stored(rows)  # distinct values only: read several times below
    return sums(placed(rows, order, marks(rows, order)), order, columns, descending, keys)
