"""Outcome rewards and message-history measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumql.functions.messages import argument_sql

# The one tool name that counts, and the rounds allowed beyond the call budget.
QUERY_TOOL = "query"
EXTRA_ROUNDS = 4
CONVERSATION = ("conv_id",)


def last_assistant_text(
    messages: DataFrame, keys: Sequence[str] = CONVERSATION, turn: str = "turn", text: str = "text"
) -> DataFrame:
    """Text of the last assistant message per conversation; '' where there is none."""
    from_assistant = F.col("role") == "assistant"
    last = F.max_by(F.when(from_assistant, F.coalesce(F.col(text), F.lit(""))), F.when(from_assistant, F.col(turn)))
    return messages.groupBy(*keys).agg(F.coalesce(last, F.lit("")).alias("final_text"))


def count_messages(
    messages: DataFrame, role: str = "tool", name: str | None = QUERY_TOOL, keys: Sequence[str] = CONVERSATION
) -> DataFrame:
    """Messages of one role (and name, unless None) per conversation, 0 included."""
    wanted = F.col("role") == role
    if name is not None:
        wanted = wanted & (F.col("name") == name)
    return messages.groupBy(*keys).agg(F.count_if(F.coalesce(wanted, F.lit(False))).alias("num_messages"))


def tool_calls(
    messages: DataFrame, keys: Sequence[str] = CONVERSATION, turn: str = "turn", calls: str = "tool_calls"
) -> DataFrame:
    """One row per tool call with id and name; ``sql`` is its trimmed argument, '' when missing or malformed."""
    return (
        messages.select(*keys, turn, F.posexplode(calls).alias("pos", "call"))
        .where(F.col("call.id").isNotNull() & F.col("call.name").isNotNull())
        .select(*keys, turn, "pos", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"),
                argument_sql(F.col("call.arguments")).alias("sql"))
    )


def apply_tool_budget(
    calls: DataFrame, max_calls: int = 8, keys: Sequence[str] = CONVERSATION, order: Sequence[str] = ("turn", "pos")
) -> DataFrame:
    """Add ``status``: ``run`` for the first ``max_calls`` query calls, ``over_budget`` after, ``unsupported`` for others.

    Only the place of the last allowed call is looked up per conversation: the rank filter limits rows before
    the shuffle, and every call is then compared with that place.
    """
    wanted = F.col("name") == QUERY_TOOL
    place = F.struct(*order)
    ranked = Window.partitionBy(*keys).orderBy(*order)
    allowed = (
        calls.where(wanted)
        .select(*keys, *order, F.row_number().over(ranked).alias("_rank"))
        .where(F.col("_rank") <= max(max_calls, 0))
    )
    last = allowed.groupBy(*keys).agg(F.max(place).alias("_last_allowed"))
    status = (
        F.when(~wanted, F.lit("unsupported"))
        .when(place <= F.col("_last_allowed"), F.lit("run"))
        .otherwise(F.lit("over_budget"))
    )
    return calls.join(last, list(keys), "left").withColumn("status", status).drop("_last_allowed")


def serve_calls(
    calls: DataFrame, max_calls: int = 8, keys: Sequence[str] = CONVERSATION, turn: str = "turn", pos: str = "pos"
) -> DataFrame:
    """Calls of the rounds that take place, with their ``status``: ``served_rounds`` and ``apply_tool_budget`` at once.

    Both limits come from one narrow pass: the rank of the turn limits rows before the shuffle, and the calls of the
    turns left are counted in the same partitions. The calls themselves are joined with the limits once.
    """
    most, wanted, place = max(max_calls, 0), F.col("name") == QUERY_TOOL, F.struct(turn, pos)
    whole = Window.partitionBy(*keys)
    first_turns = calls.select(*keys, turn, pos, "name").withColumn(
        "_rank", F.dense_rank().over(whole.orderBy(turn))).where(F.col("_rank") <= most + EXTRA_ROUNDS)
    counted = first_turns.withColumn("_calls", F.count_if(wanted).over(
        whole.orderBy(turn, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    limits = counted.groupBy(*keys).agg(
        F.max(turn).alias("_last_turn"), F.max(F.when(wanted & (F.col("_calls") <= most), place)).alias("_last_allowed"))
    status = (
        F.when(~wanted, F.lit("unsupported")).when(place <= F.col("_last_allowed"), F.lit("run")).otherwise(F.lit("over_budget"))
    )
    served = calls.join(limits, list(keys)).where(F.col(turn) <= F.col("_last_turn"))
    return served.withColumn("status", status).drop("_last_turn", "_last_allowed")


def served_rounds(
    calls: DataFrame, max_calls: int = 8, keys: Sequence[str] = CONVERSATION, turn: str = "turn"
) -> DataFrame:
    """Calls of the rounds that take place: at most ``max_calls`` + 4 turns with calls per conversation."""
    ranked = Window.partitionBy(*keys).orderBy(turn)
    turns = calls.select(*keys, turn).distinct().withColumn("_rank", F.row_number().over(ranked))
    last = turns.where(F.col("_rank") <= max(max_calls, 0) + EXTRA_ROUNDS).groupBy(*keys).agg(
        F.max(turn).alias("_last_turn")
    )
    return calls.join(last, list(keys)).where(F.col(turn) <= F.col("_last_turn")).drop("_last_turn")


def outcome_reward(
    df: DataFrame, exec_match: float = 1.0, executable: float = 0.0, exact_sql: float = 0.0
) -> DataFrame:
    """Add ``reward``: weighted sum of the three outcome flags."""

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)).cast("double")

    return df.withColumn(
        "reward",
        F.lit(float(exec_match)) * flag("exec_match")
        + F.lit(float(executable)) * flag("executable")
        + F.lit(float(exact_sql)) * flag("exact_match"),
    )


def reward_metrics(df: DataFrame, tool_enabled: bool, by: Sequence[str] = ()) -> DataFrame:
    """Mean reward and mean outcome measures per group."""

    def mean(column: Column, name: str) -> Column:
        return F.avg(column.cast("double")).alias(name)

    has_sql = F.coalesce(F.col("sql"), F.lit("")) != ""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rollouts"),
        mean(F.col("reward"), "reward"),
        mean(F.col("exec_match"), "exec_match"),
        mean(F.col("executable"), "executable"),
        mean(F.col("exact_match"), "exact_match"),
        mean(has_sql, "prediction_has_sql"),
        mean(F.col("query_tool_calls"), "query_tool_calls"),
        F.lit(1.0 if tool_enabled else 0.0).alias("query_tool_enabled"),
    )


def token_usage(
    messages: DataFrame, keys: Sequence[str] = CONVERSATION, prompt: str = "prompt_tokens",
    completion: str = "completion_tokens",
) -> DataFrame:
    """Token totals per conversation; missing counts are 0."""
    sums = messages.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col(prompt), F.lit(0))).cast("bigint").alias("prompt_tokens"),
        F.sum(F.coalesce(F.col(completion), F.lit(0))).cast("bigint").alias("completion_tokens"),
    )
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
