"""Operator inputs derived from the test tables. Every view covers its whole table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumql.functions.cells import canonical_cells


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_one_file(ordered: DataFrame, path: str) -> None:
    """The one text column of sorted rows as one file. Many tasks sort and hold their rows on disk, the one that writes
    passes them on; it would sort all of them itself, one part after the other, without that."""
    held = ordered.persist(StorageLevel.DISK_ONLY)
    try:
        held.count()
        held.coalesce(1).write.option("lineSep", " ").text(path)
    finally:
        held.unpersist()


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """Questions out of orders."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("index"),
        key.alias("question_id"),
        F.concat(F.lit("db_"), (F.col("o_custkey") % 11).cast("string")).alias("db_id"),
        F.col("o_orderpriority").alias("question"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" status "), "o_orderstatus", F.lit("\n"))).alias("evidence"),
        F.concat(F.lit("SELECT "), key.cast("string")).alias("gold_sql"),
        F.col("o_orderstatus").alias("difficulty"),
    )


def _event_number() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Generations with outcome out of events: the question is the user, event_id orders the samples."""
    k = F.col("k")
    return (
        table(spark, folder, "events")
        .withColumn("k", _event_number())
        .select(
            F.col("user_id").alias("index"),
            F.col("event_id").alias("sample_index"),
            F.when(k % 2 == 0, F.concat(F.lit("  select\t"), F.col("user_id").cast("string"), F.lit(" ;;")))
            .otherwise(F.concat(F.lit("SELECT '"), "event_type", F.lit("'"))).alias("sql"),
            F.concat(F.lit("answer "), "event_type").alias("raw_output"),
            F.when(k % 17 == 0, F.lit("timeout")).when(k % 17 == 1, F.lit("")).alias("generation_error"),
            F.col("value").alias("latency_s"),
            (k % 9).alias("query_tool_calls"),
            k.alias("prompt_tokens"),
            F.nullif(k % 5, F.lit(0)).alias("completion_tokens"),
            F.when(k % 2 == 1, k + k % 5 + 1).alias("total_tokens"),
            F.when(F.col("event_type") == "error", F.lit("boom")).alias("error"),
            (F.col("value") / 100).alias("elapsed_s"),
            F.when(F.col("event_type") == "signup", 0).otherwise(2).cast("bigint").alias("row_count"),
        )
    )


def _result_values(kind: Column, shift: Column) -> Column:
    """Rows a query of this kind returns; click and view differ in row order only."""
    a, b = shift + 1, shift + 2
    return (
        F.when(kind == "click", F.array(a, b)).when(kind == "view", F.array(b, a))
        .when(kind == "purchase", F.array(a, a)).otherwise(F.array().cast("array<bigint>"))
    )


def _exploded(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = df.select(*keys, F.posexplode("values").alias("row_pos", "value"))
    return rows.select(*keys, F.col("row_pos").cast("bigint").alias("row_pos"), canonical_cells(rows, ["value"]).alias("cells"))


def sample_results(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where(F.col("event_type") != "error")
    return _exploded(
        events.select(
            F.col("user_id").alias("index"), F.col("event_id").alias("sample_index"),
            _result_values(F.col("event_type"), _event_number() % 3).alias("values"),
        ),
        ["index", "sample_index"],
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """One question per user of events."""
    user = F.col("user_id")
    return table(spark, folder, "events").select("user_id").distinct().select(
        user.alias("index"), user.alias("question_id"),
        F.concat(F.lit("db_"), (user % 7).cast("string")).alias("db_id"),
        F.concat(F.lit("q"), user.cast("string")).alias("question"),
        F.lit("").alias("evidence"),
        F.concat(F.lit("SELECT "), user.cast("string")).alias("gold_sql"),
        F.element_at(F.array(F.lit("simple"), F.lit("moderate"), F.lit("challenging")), (user % 3 + 1).cast("int")).alias("difficulty"),
    )


def unanswered(spark: SparkSession, folder: str) -> DataFrame:
    """Questions without any sample, one per customer."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        (-1 - key).alias("index"), key.alias("question_id"), F.concat(F.lit("db_"), (key % 7).cast("string")).alias("db_id"),
        F.concat(F.lit("q"), key.cast("string")).alias("question"),
        F.lit("").alias("evidence"), F.lit("SELECT 1").alias("gold_sql"), F.lit("unanswered").alias("difficulty"),
    )


def order_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One execution without error for each order of lineitem."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("index")).distinct().withColumn("error", F.lit(None).cast("string"))


def gold(spark: SparkSession, folder: str) -> DataFrame:
    index = F.col("index")
    return users(spark, folder).select(
        "index",
        F.when(index % 29 == 0, F.lit("gold failed")).alias("error"),
        (index / 1000).alias("elapsed_s"),
        F.when(index % 4 == 3, 0).otherwise(2).cast("bigint").alias("row_count"),
    )


def gold_results(spark: SparkSession, folder: str) -> DataFrame:
    index = F.col("index")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("click", "view", "purchase", "signup")]), (index % 4 + 1).cast("int"))
    known = users(spark, folder).where(index % 29 != 0)
    return _exploded(known.select("index", _result_values(kind, index % 3).alias("values")), ["index"])


def order_results(spark: SparkSession, folder: str, side: str) -> DataFrame:
    """Result rows per order out of lineitem; predicted rows differ from gold for some orders."""
    items = table(spark, folder, "lineitem")
    key = F.col("l_orderkey")
    price = F.col("l_extendedprice")
    if side == "pred":
        price = F.when(key % 7 == 0, price + 1).when(key % 13 == 0, price + 1e-9).otherwise(price)
        twice = (key % 11 == 0) & (F.col("l_linenumber") == 1)
        items = items.withColumn("_copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = items.select(key.alias("index"), F.col("l_linenumber").cast("bigint").alias("row_pos"), "l_partkey", price.alias("price"))
    return rows.select("index", "row_pos", canonical_cells(rows, ["l_partkey", "price"]).alias("cells"))


# Answer texts; {n} is replaced by a number of the row. Chosen to hit every rule of cleaning.
ANSWER_TEMPLATES = (
    "SELECT {n}",
    "Here it is:\n```sql\nSELECT {n};\n```\nDone.",
    "<think>maybe ```drop {n}```</think>\n```SQL\n select {n} \n```",
    "<think>still thinking about {n}",
    "select 1; select {n}",
    "select ';' -- c;\n, {n}",
    "/* x; */ select {n}",
    "select/**/{n}",
    "select 'it''s;' , {n} ; x",
    "a 'unterminated ; {n}",
    "DROP TABLE t{n}",
    "select 'drop', {n}",
    "SELECT REPLACE(a, 'x', 'y'), {n}",
    "( select {n})",
    "((select {n}))",
    "",
)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Raw answers out of orders."""
    template = F.lit("")
    for i, text in reversed(list(enumerate(ANSWER_TEMPLATES))):
        template = F.when(F.col("o_orderkey") % len(ANSWER_TEMPLATES) == i, F.lit(text)).otherwise(template)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("index"),
        F.replace(template, F.lit("{n}"), F.col("o_custkey").cast("string")).alias("raw_output"),
    )


def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns whose type only their values tell."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    mixed = F.when(F.col("o_orderkey") % 10 < 8, F.col("o_orderkey").cast("string")).otherwise(F.lit("n/a"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("a_num"),
        day.alias("b_iso"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("c_slash"),
        mixed.alias("d_mix"),
        F.nullif("o_orderstatus", "o_orderstatus").alias("e_null"),
        F.nullif("o_orderstatus", F.lit("F")).alias("f_part"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("g_moment"),
    )


def call_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with parts, tool calls and usage out of events: the conversation is the user, the turn the event."""
    k = _event_number()
    call = lambda ident, name, args: F.struct(ident.alias("id"), name.alias("name"), args.alias("arguments"))
    good = F.concat(F.lit('{"sql": "  select '), k.cast("string"), F.lit(' \\n"}'))
    odd = F.when(k % 4 == 0, F.lit('{"sql": 5}')).when(k % 4 == 1, F.lit("not json")).when(k % 4 == 2, F.lit('["sql"]')).otherwise(good)
    ident = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    name = F.when(F.col("event_type") == "signup", F.lit("search")).otherwise(F.lit("query"))
    part = lambda kind, text, thinking: F.struct(
        F.lit(kind).alias("type"), text.cast("string").alias("text"), thinking.cast("string").alias("thinking"))
    nothing = F.lit(None)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(F.col("event_type") == "click", F.lit("tool")).otherwise(F.lit("assistant")).alias("role"),
        F.when(F.col("event_type") == "click", name).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("plain "), k.cast("string"))).alias("content"),
        F.when(k % 3 != 0, F.array(
            part("thinking", nothing, F.concat(F.lit("hm "), k.cast("string"))),
            part("text", F.lit(""), nothing),
            part("text", F.lit(" \n"), nothing),
            part("text", F.concat(F.lit("say "), F.col("event_type")), nothing),
        )).alias("parts"),
        F.array(
            call(ident, name, good),
            call(F.when(k % 2 == 0, ident), F.lit("query"), odd),
            call(ident, F.lit("query"), odd),
        ).alias("tool_calls"),
        F.nullif(k, F.lit(0)).alias("prompt_tokens"),
        F.nullif(k % 5, F.lit(0)).alias("completion_tokens"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction flags out of events, as they would arrive during runs."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("index"),
        (F.col("event_type") == "purchase").alias("exec_match"),
        (F.col("event_type") != "error").alias("executable"),
    )
