"""Version history of URLs: validity intervals, and the version that was live at a given time.

A key's rows are cut into cells of time (``cell``, a width in seconds). Order only matters inside a cell; from one cell
to the next goes a single value per key, taken from a map-side combined aggregate. So a key with a third of all rows is
spread over its cells, and the only rows that ever meet in one task are a key's rows of one cell and its list of cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _cell(at: str, width: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(width * 1_000_000)).alias("_cell")


def _carried(rows: DataFrame, keys: Sequence[str], value: Column, forward: bool) -> DataFrame:
    """Per key and cell, the value of the nearest other cell that has one, before it (``forward``) or after it.

    ``value`` is an aggregate over the rows of a cell, null where a cell has none.
    """
    cells = rows.groupBy(*keys, "_cell").agg(value.alias("_value"))
    order = Window.partitionBy(*keys).orderBy("_cell")
    if forward:
        near = F.last("_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.first("_value", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return cells.select(*keys, "_cell", near.alias("_carried"))


def as_of_join(
    events: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    tie: str | None = None,
    cell: int = DAY,
) -> DataFrame:
    """Every row of ``events`` with the ``values`` of its key's newest version at or before its ``at``.

    Both sides have ``keys`` and ``at``. Events without such a version, without a time or with a null key get nulls, and
    repeated events are all kept. Of versions at the same time the one with the largest ``tie`` counts. Columns of
    ``versions`` that are not asked for are not read; ``values`` must not be named like columns of ``events``.
    """
    clash = set(values) & set(events.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    content = F.struct(*[F.col(v) for v in values])
    order_tie = F.col(tie) if tie else F.lit(0)
    kept = versions.dropna(subset=[*keys, at])
    held = kept.select(*keys, at, _cell(at, cell), order_tie.alias("_tie"), content.alias("_version"))
    asked = events.select(*keys, at, _cell(at, cell), F.struct(*[F.col(c) for c in events.columns]).alias("_event"))
    rows = held.unionByName(asked, allowMissingColumns=True)
    newest = F.max_by("_version", F.when(F.col("_version").isNotNull(), F.struct(at, "_tie")))
    carried = _carried(rows, keys, newest, forward=True)
    # versions stand before events of the same time: their _event is null, and nulls sort first
    order = Window.partitionBy(*keys, "_cell").orderBy(F.col(at), F.col("_event").isNotNull(), F.col("_tie"))
    local = F.last("_version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("_local", local).filter("_event IS NOT NULL").select(*keys, "_cell", "_event", "_local")
    # plain equality, so the window's partitioning serves the join: no version has a null key or time
    joined = found.join(carried, [*keys, "_cell"], "left")
    live = F.coalesce("_local", "_carried").alias("_live")
    return joined.select("_event", live).select("_event.*", *[F.col(f"_live.{v}").alias(v) for v in values])


def version_intervals(
    observed: DataFrame, keys: Sequence[str], at: str, content: str, tie: str, cell: int = DAY
) -> DataFrame:
    """``keys, content, valid_from, valid_to`` of every run of observations with the same content.

    An observation that repeats the content before it opens nothing. ``valid_to`` is the start of the next version and
    null for the one still live. Observations without key or time are left out; null content is a content like any other.
    Equal times are ordered by ``tie``, so a version may be empty (``valid_from = valid_to``).
    """
    rows = observed.dropna(subset=[*keys, at]).select(*keys, at, F.col(content), F.col(tie), _cell(at, cell))
    ends = F.struct(at, tie)
    held = F.struct(F.col(content).alias("content"))  # never null itself, so null content is carried too
    before = _carried(rows, keys, F.max_by(held, ends), forward=True)
    local = Window.partitionBy(*keys, "_cell").orderBy(at, tie)
    previous = F.coalesce(F.lag(held).over(local), "_carried")
    joined = rows.join(before, [*keys, "_cell"])
    changed = joined.withColumn("_previous", previous)
    changed = changed.filter(F.col("_previous").isNull() | ~F.col("_previous.content").eqNullSafe(F.col(content))).drop("_previous", "_carried")
    after = _carried(changed, keys, F.min(at), forward=False)
    following = F.coalesce(F.lead(at).over(local), "_carried")
    return changed.join(after, [*keys, "_cell"]).select(*keys, content, F.col(at).alias("valid_from"), following.alias("valid_to"))
