"""The rows at given ranks of an order, found by counting instead of sorting the table.

Each round takes a few keys out of the range that is left, counts how many rows lie at and between them, and goes on in
the gap that holds the rank; only the counts are shuffled. A range of at most ``SMALL`` rows is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.session import freeze

SPLITTERS, SMALL = 64, 10_000

Key = tuple


def _key(columns: Sequence[str]) -> Column:
    return F.struct(*columns)


def _literal(key: Key, rows: DataFrame) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, rows.schema)])


def _key_at(rows: DataFrame, rank: int, n: int, splitters: int, small: int) -> Key | None:
    """Key of the row at ``rank`` of ``rows``, whose columns are the order; nulls come first."""
    if not 0 <= rank < n:
        return None
    left, key = rows, _key(rows.columns)
    while n > small:
        taken = left.orderBy(F.xxhash64(*rows.columns)).limit(splitters).distinct().orderBy(*rows.columns).collect()
        cuts = F.array(*[_literal(t, rows) for t in taken])
        below = F.size(F.filter(cuts, lambda c: c < key))
        equal = F.array_contains(F.transform(cuts, lambda c: c.eqNullSafe(key)), True)
        # Place 2i + 1 is the i-th cut itself, 2i the gap before it.
        counts = dict(left.groupBy((2 * below + equal.cast("int")).alias("place")).count().collect())
        for place in sorted(counts):
            if rank < counts[place]:
                break
            rank -= counts[place]
        if place % 2:
            return tuple(taken[place // 2])
        if place:
            left = left.where(key > _literal(taken[place // 2 - 1], rows))
        if place // 2 < len(taken):
            left = left.where(key < _literal(taken[place // 2], rows))
        n = counts[place]
    return tuple(left.orderBy(*rows.columns).offset(rank).limit(1).first())


def keys_at(df: DataFrame, order: Sequence[str | Column], ranks: Sequence[int], splitters: int = SPLITTERS, small: int = SMALL) -> list[Key | None]:
    """The order's values of the rows at the 0-based ``ranks``, null before all others; None for a rank past the last row."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = freeze(df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]), "order")
    n = rows.count()
    return [_key_at(rows, r, n, splitters, small) for r in ranks]


def between_ranks(df: DataFrame, order: Sequence[str | Column], start: int, stop: int | None, **options) -> DataFrame:
    """Rows whose order's values lie between those at the ranks ``start`` and ``stop`` - 1, both included.

    Rows that share the first or last key all belong to the slice. A single column without nulls there is compared as it
    is, so the condition can reach the scan.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    low, high = keys_at(df, columns, [start, *([] if stop is None else [max(start, stop) - 1])], **options) + ([None] if stop is None else [])
    if low is None or (stop is not None and stop <= start):
        return df.where(F.lit(False))
    rows = df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    if len(columns) == 1 and low[0] is not None:
        own, bounds = columns[0], [F.lit(k[0]).cast(rows.schema[0].dataType) if k is not None else None for k in (low, high)]
    else:
        own = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
        bounds = [_literal(k, rows) if k is not None else None for k in (low, high)]
    kept = df.where(own >= bounds[0]) if start > 0 else df
    return kept if bounds[1] is None else kept.where(own <= bounds[1])
