"""Row numbers and running values over any ordering, without ever putting one group into one task.

A window without a partition key, or with one hot key, runs in a single task. Here rows are range-sorted by Spark
on the full ordering (ties broken by later columns, so one heavy value spreads over many partitions), the sorted
rows are written once with their partition id, and each partition's totals are carried forward over the small
table of partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumql.session import freeze

SEGMENT = "_segment"
OFFSET = "_offset"
_PARTITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _segmented(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    ordered = df.orderBy(*_columns(order)).withColumn("_row_id", F.monotonically_increasing_id())
    return freeze(
        ordered.withColumn(SEGMENT, F.shiftright("_row_id", _PARTITION_BITS).cast("int"))
        .withColumn(OFFSET, F.col("_row_id").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1)))
        .drop("_row_id"),
        "ordered",
    )


def with_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "position", key: Sequence[str] | None = None
) -> DataFrame:
    """Add the 0-based position of each row in ``order``; the ordering should have no ties.

    With a unique ``key`` only key and ordering are sorted and written, and wide rows are joined to their position.
    """
    if key is not None:
        slots = {f"_order_{i}": c for i, c in enumerate(_columns(order))}
        narrow = df.select(*key, *[c.alias(n) for n, c in slots.items()])
        placed = with_position(narrow, list(slots), name).select(*key, name)
        return null_safe_join(df, placed, key)
    rows = _segmented(df, order)
    sizes = rows.groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition of the sort, so this window is as small as the partition count.
    before = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(SEGMENT, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(starts, SEGMENT)
        .withColumn(name, F.col("_start") + F.col(OFFSET))
        .drop(SEGMENT, OFFSET, "_start")
    )


def with_group_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row inside its group; a hot group is numbered by many tasks."""
    placed = with_position(df, [*keys, *order], "_overall")
    firsts = placed.groupBy(*keys).agg(F.min("_overall").alias("_first"))
    joined = null_safe_join(placed, firsts, keys)
    return joined.withColumn(name, F.col("_overall") - F.col("_first")).drop("_overall", "_first")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    inclusive: bool = True,
    combine: str = "sum",
) -> DataFrame:
    """Add running values per group: for each name the sum (or max) of its expression up to the row.

    ``inclusive=False`` leaves the row itself out. The value before the first row is null for max, 0 for sum.
    """
    if combine not in ("sum", "max"):
        raise ValueError("combine must be 'sum' or 'max'")
    fold = F.sum if combine == "sum" else F.max
    sources = {f"_source_{i}": expression for i, expression in enumerate(totals.values())}
    rows = _segmented(df.withColumns(sources), [*keys, *order])

    last = 0 if inclusive else -1
    within = Window.partitionBy(SEGMENT, *keys).orderBy(OFFSET).rowsBetween(Window.unboundedPreceding, last)
    local = rows.withColumns({f"_local_{s}": fold(s).over(within) for s in sources})

    per_segment = rows.groupBy(SEGMENT, *keys).agg(*[fold(s).alias(f"_part_{s}") for s in sources])
    # At most one row per group and partition of the sort.
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_segment.select(
        SEGMENT, *keys, *[fold(f"_part_{s}").over(before).alias(f"_carry_{s}") for s in sources]
    )
    joined = null_safe_join(local, carried, [SEGMENT, *keys])
    result = {}
    for name, source in zip(totals, sources):
        here, carry = F.col(f"_local_{source}"), F.col(f"_carry_{source}")
        if combine == "sum":
            result[name] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        else:
            result[name] = F.greatest(here, carry)
    return joined.withColumns(result).select(*df.columns, *totals)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, keeping the left key columns once."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_right_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
