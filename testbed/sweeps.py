"""Sweeps, metric logs and run files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumql.operators import sweeps
from quorumql.session import new_folder
from quorumql.sources import records
from testbed import inputs
from testbed.registry import query


def _raw_metrics(spark, folder):
    """Metric rows as text, some of it malformed, out of orders."""
    key = F.col("o_orderkey")
    return inputs.table(spark, folder, "orders").select(
        F.when(key % 7 == 0, F.lit(" ")).when(key % 7 == 1, F.lit("x"))
        .otherwise(F.concat((key % 9).cast("string"), F.lit(".9"))).alias("k"),
        F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("execution_accuracy"),
        F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit("1e3")).otherwise(F.lit("-2.5")).alias("duration_s"),
        key.cast("string").alias("run_dir"),
    )


_METRICS_SQL = """metrics AS (SELECT o_orderkey AS key,
  CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey % 9 END AS k,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS execution_accuracy,
  CASE o_orderkey % 3 WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN -2.5::DOUBLE END AS duration_s FROM orders)"""


@query("coerce_metrics", f"""WITH {_METRICS_SQL} SELECT k, execution_accuracy, duration_s, CAST(key AS VARCHAR) AS run_dir
FROM metrics WHERE k IS NOT NULL""")
def _coerce_metrics(spark, folder):
    return sweeps.coerce_metrics(_raw_metrics(spark, folder), ["k"], ["execution_accuracy", "duration_s"])


@query("sweep_csv", f"""WITH {_METRICS_SQL} SELECT k, execution_accuracy, duration_s, NULL::DOUBLE AS executable_rate,
CAST(key AS VARCHAR) AS run_dir FROM metrics WHERE k IS NOT NULL""")
def _sweep_csv(spark, folder):
    path = new_folder(spark, "sweep")
    records.write_sweep(_raw_metrics(spark, folder), path, "csv")
    read = records.read_sweep(spark, csv_path=path)
    return sweeps.coerce_metrics(read, ["k"], ["execution_accuracy", "duration_s", "executable_rate"]).select(
        "k", "execution_accuracy", "duration_s", "executable_rate", "run_dir")


@query("sweep_csv_by_name", f"""WITH {_METRICS_SQL} SELECT k, execution_accuracy, duration_s, NULL::DOUBLE AS executable_rate,
CAST(key AS VARCHAR) AS run_dir FROM metrics WHERE k IS NOT NULL""")
def _sweep_csv_by_name(spark, folder):
    # Columns in another order, one of them unknown.
    path = new_folder(spark, "sweep")
    _raw_metrics(spark, folder).select("run_dir", F.lit("x").alias("other"), "execution_accuracy", "k", "duration_s").write.option("header", True).csv(path)
    return sweeps.coerce_metrics(records.read_sweep(spark, csv_path=path), ["k"], ["execution_accuracy", "duration_s", "executable_rate"]).select(
        "k", "execution_accuracy", "duration_s", "executable_rate", "run_dir")


@query("sweep_json", f"""WITH {_METRICS_SQL} SELECT k, execution_accuracy, duration_s, NULL::DOUBLE AS executable_rate,
CAST(key AS VARCHAR) AS run_dir FROM metrics WHERE k IS NOT NULL""")
def _sweep_json(spark, folder):
    return _sweep_through(spark, folder, "json", "json_path")


@query("sweep_jsonl", f"""WITH {_METRICS_SQL} SELECT k, execution_accuracy, duration_s, NULL::DOUBLE AS executable_rate,
CAST(key AS VARCHAR) AS run_dir FROM metrics WHERE k IS NOT NULL""")
def _sweep_jsonl(spark, folder):
    return _sweep_through(spark, folder, "jsonl", "jsonl_path")


def _sweep_through(spark, folder, fmt, argument):
    path = new_folder(spark, "sweep")
    records.write_sweep(_raw_metrics(spark, folder), path, fmt)
    return sweeps.coerce_metrics(records.read_sweep(spark, **{argument: path}), ["k"], ["execution_accuracy", "duration_s", "executable_rate"]).select(
        "k", "execution_accuracy", "duration_s", "executable_rate", "run_dir")


@query("last_record_per_run", """SELECT user_id AS run_id, max(event_id) AS seq, arg_max(props, event_id) AS metrics,
arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def _last_record(spark, folder):
    log = inputs.table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("props").alias("metrics"), "event_type")
    return sweeps.last_record(sweeps.require_objects(log, "metrics"), ["run_id"], "seq")


@query("latest_sweep", """SELECT strftime(ts, '%Y%m%d_%H') AS sweep_id, event_id FROM events
WHERE strftime(ts, '%Y%m%d_%H') = (SELECT max(strftime(ts, '%Y%m%d_%H')) FROM events)""")
def _latest_sweep(spark, folder):
    stamped = inputs.table(spark, folder, "events").select(F.date_format("ts", "yyyyMMdd_HH").alias("sweep_id"), "event_id")
    return sweeps.latest(stamped, "sweep_id")


@query("run_duration", """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN round(value * 60, 2) END AS duration_s FROM events""")
def _run_duration(spark, folder):
    events = inputs.table(spark, folder, "events")
    started = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.timestamp_add("SECOND", F.round(F.col("value") * 60, 0).cast("int"), F.col("ts"))
    micros = F.round((F.col("value") * 60 - F.round(F.col("value") * 60, 0)) * 1e6, 0).cast("int")
    later = F.timestamp_add("MICROSECOND", micros, later)
    finished = (
        F.when(F.col("event_id") % 4 == 2, F.lit("not a time")).when(F.col("event_id") % 4 == 3, F.lit(None).cast("string"))
        .otherwise(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return events.select("event_id", F.round(sweeps.run_duration(started, finished), 2).alias("duration_s"))


def _summaries(spark, folder, divisor: int):
    """Summary records keyed by arm out of orders; the two sources cover different arms."""
    key = F.col("o_orderkey")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return inputs.table(spark, folder, "orders").where(key % divisor != 0).select(
        key.alias("arm_id"), (F.col("o_totalprice") / divisor).alias("execution_accuracy"),
        F.lit(0.5).alias("exact_match_accuracy"), F.lit(0.75).alias("executable_rate"),
        F.col("o_totalprice").alias("avg_total_tokens_per_example"), F.lit(1.0).alias("avg_query_tool_calls_per_example"),
        F.lit(1.0).alias("avg_self_consistency_vote_fraction"), F.col("o_custkey").alias("num_examples"),
        stamp.alias("started_at"),
        F.date_format(F.timestamp_add("SECOND", F.col("o_custkey").cast("int"), F.col("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"),
        F.concat(F.lit("run/"), key.cast("string")).alias("run_dir"),
    )


@query("sweep_metrics", """WITH arms AS (
  SELECT *, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 THEN 3 WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 THEN 3
    WHEN o_orderkey % 4 <> 0 AND o_orderkey % 2 <> 0 THEN 2 END AS ignored,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 THEN 3 WHEN o_orderkey % 2 <> 0 THEN 2 END AS d FROM orders)
SELECT o_orderkey AS arm_id, o_orderkey % 10 AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' END AS error,
round(o_totalprice / d, 4) AS execution_accuracy, CASE WHEN d IS NOT NULL THEN o_custkey END AS num_examples,
CASE WHEN d IS NOT NULL THEN CAST(o_custkey AS DOUBLE) END AS duration_s,
CASE WHEN d IS NOT NULL THEN 'run/' || o_orderkey END AS run_dir,
CASE WHEN d IS NOT NULL THEN 'local/' || o_orderkey || '/summary.json' END AS local_summary_path FROM arms""")
def _sweep_metrics(spark, folder):
    key = F.col("o_orderkey")
    arms = inputs.table(spark, folder, "orders").select(
        key.alias("arm_id"), (key % 10).alias("k"), F.when(key % 4 == 0, F.lit("failed")).alias("error"),
        F.when(key % 4 != 0, F.concat(F.lit("local/"), key.cast("string"))).alias("local_run_dir"))
    made = sweeps.sweep_metrics(arms, _summaries(spark, folder, 3), _summaries(spark, folder, 2))
    return made.select(
        "arm_id", "k", "error", F.round("execution_accuracy", 4).alias("execution_accuracy"), "num_examples",
        "duration_s", "run_dir", "local_summary_path")


def _arms(spark, folder):
    return inputs.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("x"), "o_orderpriority",
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("score"))


@query("rank_arms", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS score,
row_number() OVER (ORDER BY CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS rank,
CASE WHEN o_orderkey % 6 <> 0 THEN printf('%.4f', o_totalprice) ELSE 'n/a' END AS score_text FROM orders""")
def _rank_arms(spark, folder):
    return sweeps.rank_arms(_arms(spark, folder).select("k", "score"), "score")


_FRONT_SQL = """SELECT p.k, p.x, p.score{0} FROM points p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT x{0}, max(score) AS best FROM points GROUP BY ALL) o
  WHERE {1} o.x <= p.x AND o.best >= p.score AND (o.x < p.x OR o.best > p.score))"""
_POINTS_SQL = """WITH points AS (SELECT o_orderkey AS k, o_custkey AS x, o_orderpriority, o_totalprice AS score
FROM orders WHERE o_orderkey % 6 <> 0) """


@query("pareto_frontier", _POINTS_SQL + _FRONT_SQL.format("", ""))
def _pareto(spark, folder):
    return sweeps.pareto_frontier(_arms(spark, folder).select("k", "x", "score"), "x", "score")


@query("pareto_frontier_grouped", _POINTS_SQL + _FRONT_SQL.format(", o_orderpriority", "o.o_orderpriority = p.o_orderpriority AND"))
def _pareto_grouped(spark, folder):
    return sweeps.pareto_frontier(_arms(spark, folder), "x", "score", ["o_orderpriority"])


@query("k_series", """SELECT o_orderkey AS k, o_totalprice AS score FROM orders WHERE o_orderkey % 6 <> 0""")
def _k_series(spark, folder):
    return sweeps.k_series(_arms(spark, folder), "k", "score")


_LOG_SQL = """log AS (SELECT event_id, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
named AS (SELECT event_id, user_id, CASE WHEN k % 4 = 0 THEN CAST(k AS DOUBLE) WHEN k % 4 = 2 THEN k / 8.0::DOUBLE END AS loss,
  CASE WHEN k % 4 <> 3 THEN CAST(k AS DOUBLE) / 4 END AS exec_match FROM log)"""


def _metric_log(spark, folder):
    """Metric records with slash-named numbers, some as text, out of events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    record = (
        F.when(k % 4 == 0, F.format_string('{"loss": %d, "env/all/exec_match": %s}', k, (k / 4).cast("string")))
        .when(k % 4 == 1, F.format_string('{"train/loss": "%d", "env/all/exec_match": %s}', k, (k / 4).cast("string")))
        .when(k % 4 == 2, F.format_string(
            '{"loss": 99, "optim/loss": %s, "env/all/exec_match": %s}', (k / 8).cast("string"), (k / 4).cast("string")))
        .otherwise(F.lit('{"env/all/exec_match": null}')))
    return inputs.table(spark, folder, "events").select("event_id", "user_id", record.alias("metrics"))


@query("metric_alias", f"""WITH {_LOG_SQL} SELECT event_id, loss AS train_loss, exec_match AS train_exec_match,
NULL::DOUBLE AS eval_exec_match FROM named""")
def _metric_alias(spark, folder):
    found = sweeps.metric_alias(_metric_log(spark, folder))
    return found.select("event_id", *[
        F.col(f"`{side}/{name}`").alias(f"{side}_{name}") for side, name in
        (("train", "loss"), ("train", "exec_match"), ("eval", "exec_match"))])


@query("arm_results", f"""WITH {_LOG_SQL}, last AS (SELECT user_id, arg_max(n, event_id) AS n FROM (SELECT user_id, event_id, named AS n FROM named) GROUP BY user_id)
SELECT c_custkey AS arm, c_mktsegment AS segment, coalesce(printf('%.4f', n.loss), 'n/a') AS train_loss,
coalesce(printf('%.4f', n.exec_match), 'n/a') AS train_exec_match FROM customer LEFT JOIN last ON user_id = c_custkey""")
def _arm_results(spark, folder):
    last = sweeps.last_record(_metric_log(spark, folder), ["user_id"], "event_id")
    found = sweeps.metric_alias(last).withColumnRenamed("user_id", "arm")
    grid = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("arm"), F.col("c_mktsegment").alias("segment"))
    table = sweeps.arm_results(grid, found, ["arm"], ["segment"])
    return table.select("arm", "segment", F.col("`train/loss`").alias("train_loss"), F.col("`train/exec_match`").alias("train_exec_match"))
