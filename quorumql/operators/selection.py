"""Choosing, ordering, splitting, batching and replicating examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.operators.positions import with_position
from quorumql.operators.ranks import between_ranks


def filter_by_db(examples: DataFrame, db_id: str | None = None) -> DataFrame:
    """Keep one database; None or '' keeps all."""
    return examples.where(F.col("db_id") == db_id) if db_id else examples


def slice_rows(
    df: DataFrame, offset: int = 0, limit: int | None = None, order: Sequence[str] = ("index",)
) -> DataFrame:
    """Rows ``offset .. offset+limit`` in order. An offset of 0 or below is ignored, limit None takes all, 0 none.

    The order columns must identify a row, null being a value like any other and the first. The keys at both ends are
    found by counting, and the slice is a filter between them: nothing is sorted.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    if offset <= 0 and limit is None:
        return df
    if limit == 0:
        return df.where(F.lit(False))
    return between_ranks(df, order, max(offset, 0), None if limit is None else max(offset, 0) + limit)


def slice_strict(df: DataFrame, offset: int, limit: int, order: Sequence[str] = ("index",)) -> DataFrame:
    """Like ``slice_rows``, but a negative offset is an error and a limit of 0 or below means no limit."""
    if offset < 0:
        raise ValueError("an offset cannot lie before the first row")
    return slice_rows(df, offset, limit if limit > 0 else None, order)


def select_examples(
    examples: DataFrame,
    db_id: str | None = None,
    offset: int = 0,
    limit: int | None = None,
    order: Sequence[str] = ("index",),
) -> DataFrame:
    """Filter by database first, then slice by position among what is left."""
    return slice_rows(filter_by_db(examples, db_id), offset, limit, order)


def shuffle_key(seed: int, key: str | Column = "index") -> Column:
    """Sort key of the seeded shuffle: a hash of seed and row key, the same on any cluster layout."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")))


def seeded_shuffle(df: DataFrame, seed: int = 0, key: str = "index", name: str = "position") -> DataFrame:
    """Add each row's position in the seeded random order; ``key`` must identify a row."""
    return with_position(df, [shuffle_key(seed, key), F.col(key)], name, key=[key])


def train_eval_split(
    examples: DataFrame,
    train_offset: int = 0,
    train_limit: int = 256,
    eval_offset: int | None = None,
    eval_limit: int = 64,
    seed: int | None = 0,
    key: str = "index",
) -> DataFrame:
    """Rows tagged ``split`` = train or eval with their 0-based ``position`` in the split.

    The eval part starts right behind the train part unless told otherwise; an explicit offset may overlap, and
    such rows then appear in both. A limit of 0 or below means all; seed None keeps key order.
    """
    if train_offset < 0 or (eval_offset is not None and eval_offset < 0):
        raise ValueError("an offset cannot lie before the first row")
    order = [F.col(key)] if seed is None else [shuffle_key(seed, key), F.col(key)]
    train_stop = train_offset + train_limit if train_limit > 0 else None
    # Without an explicit start, eval begins where train really ends; past the last row both are empty anyway.
    eval_start = train_stop if eval_offset is None else eval_offset

    def part(label: str, start: int, stop: int | None) -> DataFrame:
        """The rows of one part; only they are sorted, for their positions."""
        placed = with_position(between_ranks(examples, order, start, stop), order, "_place", key=[key])
        return placed.select(*examples.columns, F.lit(label).alias("split"), F.col("_place").alias("position"))

    train = part("train", train_offset, train_stop)
    if eval_start is None:
        return train
    return train.unionByName(part("eval", eval_start, eval_start + eval_limit if eval_limit > 0 else None))


def require_train_rows(split: DataFrame) -> DataFrame:
    """Return ``split`` unchanged, or raise when it has no train rows (reads at most one row)."""
    if split.where(F.col("split") == "train").isEmpty():
        raise ValueError("no training examples selected; check the train offset and limit")
    return split


def assign_batches(df: DataFrame, groups_per_batch: int, position: str = "position") -> DataFrame:
    """Consecutive runs of ``groups_per_batch`` positions form a batch; the last one may be short."""
    if groups_per_batch <= 0:
        raise ValueError("a batch needs one group at least")
    place = F.col(position)
    return df.withColumn("batch_index", F.floor(place / groups_per_batch)).withColumn(
        "group_index", place % groups_per_batch
    )


def batch(df: DataFrame, batch_index: int, groups_per_batch: int, position: str = "position") -> DataFrame:
    """The rows of one batch; an index out of range is an error."""
    rows = assign_batches(df, groups_per_batch, position).where(F.col("batch_index") == batch_index)
    if batch_index < 0 or rows.isEmpty():
        raise IndexError(f"batch index out of range: {batch_index}")
    return rows


def count_batches(df: DataFrame, groups_per_batch: int, by: Sequence[str] = ()) -> DataFrame:
    """Number of rows and of batches, per ``by`` group."""
    if groups_per_batch <= 0:
        raise ValueError("a batch needs one group at least")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.ceil(F.count(F.lit(1)) / groups_per_batch).alias("num_batches"),
    )


def replicate(df: DataFrame, group_size: int) -> DataFrame:
    """Repeat each row ``group_size`` times with ``rollout_index`` 0..group_size-1."""
    if group_size <= 0:
        raise ValueError("a group needs one rollout at least")
    return df.withColumn("rollout_index", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))


def distinct_dbs(examples: DataFrame) -> DataFrame:
    return examples.select("db_id").distinct()


def preview(examples: DataFrame) -> DataFrame:
    """Examples per database plus one total row (null ``db_id``) with the number of databases."""
    per_db = examples.groupBy("db_id").agg(F.count(F.lit(1)).alias("num_examples"))
    return per_db.rollup("db_id").agg(
        F.sum("num_examples").alias("num_examples"), F.count(F.lit(1)).alias("num_databases")
    )
