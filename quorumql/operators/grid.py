"""Hyper-parameter grids laid over tables of base configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

# Short names used in arm tags; other keys use their first four characters.
TAG_NAMES = {
    "learning_rate": "lr",
    "group_size": "gs",
    "groups_per_batch": "gpb",
    "lora_rank": "lora",
    "temperature": "t",
    "loss_fn": "loss",
    "kl_penalty_coef": "kl",
    "reward_exec_match": "rexec",
    "reward_executable": "rexe",
    "num_substeps": "sub",
}
TAG_FALLBACK_CHARS = 4


def config_grid(base: DataFrame, grid: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Every combination of the grid values on top of every base row; grid values replace same-named columns.

    ``arm_index`` numbers the combinations with the last key varying fastest. Each combination is decoded from its
    number, so the product is one ``explode`` over a sequence and no join.
    """
    total = 1
    for values in grid.values():
        total *= len(values)
    if total == 0:
        return base.where(F.lit(False)).withColumns(
            {"arm_index": F.lit(0), **{k: F.lit(None) for k in grid}}
        )
    arms = base.withColumn("arm_index", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    chosen: dict[str, Column] = {}
    stride = total
    for key, values in grid.items():
        stride //= len(values)
        digit = F.floor(F.col("arm_index") / stride).cast("int") % len(values)
        chosen[key] = F.element_at(F.array(*[F.lit(v) for v in values]), digit + 1)
    return arms.withColumns(chosen)


def config_tag(keys: Sequence[str]) -> Column:
    """Readable tag of the swept values, e.g. ``lr1e-05_gs8``. Keep float values as text to control their form."""
    return F.concat_ws("_", *[
        F.concat(F.lit(TAG_NAMES.get(key, key[:TAG_FALLBACK_CHARS])), F.col(key).cast("string")) for key in keys
    ])
