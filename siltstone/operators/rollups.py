"""Counts, shares and distinct values at every level of a report, in one pass over the rows.

Rows are first counted per combination of all dimensions, which combines map-side; levels are made of those counts, so
the copies that grouping sets need are copies of a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _finest(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    return materialise(rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("n")), "finest")


def _measures(dims: Sequence[str]) -> list:
    return [
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"),
        *[F.countDistinct(F.col(f"_of_{d}")).alias(f"distinct_{d}") for d in dims],
    ]


def _share(n, total):
    return F.round(n * 100.0 / total, 6)


def cube_report(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """``dims, level, n, distinct_<dim>..., pct`` for all subsets of ``dims``, or only those in ``sets``.

    ``level`` is the grouping id: the bit of a dimension is set where it is summed up (and its column is null), which
    tells it from a dimension that is null in the rows. Distinct counts leave nulls out. ``pct`` is the share of all rows.
    An empty table gives an empty report, without a grand total.
    """
    finest = _finest(rows, dims)
    spread = finest.select("*", *[F.col(d).alias(f"_of_{d}") for d in dims])
    grouped = spread.cube(*dims) if sets is None else spread.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dims])
    counted = grouped.agg(*_measures(dims))
    total = finest.agg(F.sum("n"))
    return counted.withColumn("pct", _share(F.col("n"), total.scalar()))


def rollup_report(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """As `cube_report` for the prefixes of ``dims``, with ``pct_parent``: the share of the next coarser level.

    The first level's parent is the grand total, a scalar; deeper levels join their parents on all of the parent's
    dimensions, so no task holds more than one parent's children.
    """
    sets = [dims[:i] for i in range(len(dims) + 1)]
    report = materialise(cube_report(rows, dims, sets), "rollup")
    full = (1 << len(dims)) - 1
    parent_of = {full >> i: full >> (i - 1) for i in range(1, len(dims) + 1)}
    total = report.filter(F.col("level") == full).agg(F.max("n"))
    top = report.filter(F.col("level").isin([full, full >> 1]))
    parts = [top.withColumn("pct_parent", F.when(F.col("level") != full, _share(F.col("n"), total.scalar())))]
    for depth in range(2, len(dims) + 1):
        level = full >> depth
        child = report.filter(F.col("level") == level)
        parent = report.filter(F.col("level") == parent_of[level]).select(*[F.col(d).alias(f"_p_{d}") for d in dims[: depth - 1]], F.col("n").alias("_n"))
        joined = child.join(parent, [F.col(d).eqNullSafe(F.col(f"_p_{d}")) for d in dims[: depth - 1]])
        parts.append(joined.withColumn("pct_parent", _share(F.col("n"), F.col("_n"))).select(*report.columns, "pct_parent"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
