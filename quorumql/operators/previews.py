"""Small JSON previews of many query results: row cap, cell clipping and an output budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumql.functions.render import json_text
from quorumql.functions.sqltext import extract_fence, first_statement, is_read_only, split_statements, strip_think
from quorumql.functions.text import clip

# Payload texts and the least each limit can be set to.
MISSING_SQL = "Missing `sql` argument. Provide one SQL statement."
NOT_READ_ONLY = "Only read-only SELECT/WITH/PRAGMA/EXPLAIN SQL is allowed."
TRUNCATED_ROWS = "Output truncated. Query fewer rows/columns for more detail."
TRUNCATED = "Output truncated."
LEAST_ROWS, LEAST_OUTPUT_CHARS, LEAST_CELL_CHARS = 1, 512, 16


def preview_rows(results: DataFrame, max_rows: int = 50, keys: Sequence[str] = ("index",)) -> DataFrame:
    """First ``max_rows`` rows of each result; the rank filter limits rows per task before the shuffle."""
    limit = max(LEAST_ROWS, max_rows)
    ranked = Window.partitionBy(*keys).orderBy("row_pos")
    return results.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= limit).drop("_rank")


def row_counts(results: DataFrame, max_rows: int = 50, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Rows kept per result, and whether some were cut."""
    limit = max(LEAST_ROWS, max_rows)
    total = F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        F.least(total, F.lit(limit)).alias("returned_rows"), (total > limit).alias("rows_truncated")
    )


def clip_cell(value: Column, max_cell_chars: int = 200) -> Column:
    """Text cut to the limit plus ``...``; null stays."""
    return clip(value, max(LEAST_CELL_CHARS, max_cell_chars))


def cell_json(cell: Column, max_cell_chars: int = 200) -> Column:
    """JSON form of a tagged cell: null, numbers and booleans as they are, text clipped and quoted.

    ``shown_cells`` gives cells with values untouched; canonical cells, made for comparing, are taken as well.
    """
    body = F.substring(cell, F.lit(3), F.length(cell))
    return (
        F.when(cell.isNull(), F.lit("null"))
        .when(cell.startswith("d:") | cell.startswith("j:"), body)
        .otherwise(json_text(clip_cell(body, max_cell_chars)))
    )


def row_json(cells: Column, max_cell_chars: int = 200) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(cells, lambda c: cell_json(c, max_cell_chars)), ", "), F.lit("]")
    )


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def _member(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f'"{name}": '), F.lit(value) if isinstance(value, str) else value)


def _bool(value: Column) -> Column:
    return F.when(value, F.lit("true")).otherwise(F.lit("false"))


def preview_status(queries: DataFrame) -> DataFrame:
    """Add ``status``: ``missing``, ``not_read_only``, ``error`` or ``ok``, in the order they are checked.

    The statement is taken out of ``sql`` first (thoughts, code fence, further statements), and ``sql`` becomes it.
    """
    body = extract_fence(strip_think(F.coalesce(F.col("sql"), F.lit(""))))
    taken = queries.withColumn("_body", body).withColumn("_statements", split_statements(F.col("_body")))
    taken = taken.withColumn("sql", first_statement(F.col("_statements"), F.col("_body"))).drop("_body", "_statements")
    text = F.col("sql")
    return taken.withColumn(
        "status",
        F.when(text == "", F.lit("missing"))
        .when(~is_read_only(text), F.lit("not_read_only"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .otherwise(F.lit("ok")),
    )


def previews(
    queries: DataFrame,
    results: DataFrame,
    max_rows: int = 50,
    max_cell_chars: int = 200,
    max_output_chars: int = 6000,
    keys: Sequence[str] = ("index",),
) -> DataFrame:
    """JSON payload of at most ``max_output_chars`` characters per query.

    ``queries`` holds the keys, sql, error and ``columns`` (array of names); rows are shown from the column ``shown``
    of ``results`` if there is one, or else from their canonical cells. Rows are dropped from the end until
    the payload fits, then the row list itself, then all but the flags. At most ``max_rows`` rows per query are
    gathered; everything beyond is only counted.
    """
    budget = max(LEAST_OUTPUT_CHARS, max_output_chars)
    limit = max(LEAST_ROWS, max_rows)
    on = list(keys)
    texts = (
        preview_rows(results, limit, keys)
        .select(*on, "row_pos", row_json(F.col("shown" if "shown" in results.columns else "cells"), max_cell_chars).alias("row_text"))
        .groupBy(*on)
        .agg(F.array_sort(F.collect_list(F.struct("row_pos", "row_text")))["row_text"].alias("_rows"))
    )
    cut = row_counts(results, limit, keys).select(*on, "rows_truncated")
    joined = (
        preview_status(queries).join(texts, on, "left").join(cut, on, "left")
        .withColumn("_rows", F.coalesce("_rows", F.array().cast("array<string>")))
        .withColumn("_cut", _bool(F.coalesce("rows_truncated", F.lit(False))))
        .withColumn("_n", F.size("_rows"))
        .withColumn("_columns", F.concat(
            F.lit("["), F.array_join(F.transform("columns", json_text), ", "), F.lit("]")))
    )
    head = [_member("ok", "true"), _member("sql", json_text(F.col("sql"))), _member("columns", F.col("_columns"))]

    def payload(rows: Column, count: Column, *extra: Column) -> Column:
        return _object(
            *head,
            _member("rows", F.concat(F.lit("["), F.array_join(rows, ", "), F.lit("]"))),
            _member("returned_rows", count.cast("string")),
            _member("row_limit", str(limit)),
            _member("rows_truncated", F.col("_cut")),
            *extra,
        )

    mark = _member("output_truncated", "true")
    # One pass over the rows carries the length so far and the most rows whose shortened payload fits.
    grown = joined.withColumn("_bare", F.length(payload(F.array().cast("array<string>"), F.lit(""), mark)))

    def fitting(length: Column, rows: Column, best: Column) -> Column:
        return F.when(F.col("_bare") + F.length(rows.cast("string")) + length <= budget, rows).otherwise(best)

    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("rows"),
                     fitting(F.lit(0), F.lit(0), F.lit(None).cast("int")).cast("int").alias("best"))

    def add(state: Column, row: Column) -> Column:
        length = (state["length"] + F.length(row) + F.when(state["rows"] > 0, 2).otherwise(0)).cast("int")
        rows = (state["rows"] + 1).cast("int")
        # The last row is never part of a shortened payload.
        best = F.when(rows < F.col("_n"), fitting(length, rows, state["best"])).otherwise(state["best"])
        return F.struct(length.alias("length"), rows.alias("rows"), best.cast("int").alias("best"))

    kept = F.aggregate("_rows", start, add, lambda state: state["best"])
    shaped = (
        grown.withColumn("_kept", F.when(F.col("_n") > 0, kept))
        .withColumn("_full", payload(F.col("_rows"), F.col("_n")))
        .withColumn("_short", payload(F.slice("_rows", F.lit(1), F.coalesce("_kept", F.lit(0))), F.col("_kept"), mark))
        .withColumn("_no_rows", _object(
            *head, _member("returned_rows", "0"), _member("row_limit", str(limit)),
            _member("rows_truncated", F.col("_cut")), mark, _member("message", json_text(F.lit(TRUNCATED_ROWS))),
        ))
    )
    fits_full = F.length("_full") <= budget
    fits_short = F.col("_kept").isNotNull()
    fits_head = F.length("_no_rows") <= budget

    def failed(message: Column, *extra: Column) -> Column:
        return _object(_member("ok", "false"), _member("error", json_text(message)), *extra)

    def minimal(flag: str) -> Column:
        return _object(_member("ok", flag), mark, _member("message", json_text(F.lit(TRUNCATED))))

    ok_text = (
        F.when(fits_full, F.col("_full")).when(fits_short, F.col("_short"))
        .when(fits_head, F.col("_no_rows")).otherwise(minimal("true"))
    )
    error_full = failed(F.col("error"), _member("sql", json_text(F.col("sql"))))
    error_marked = failed(
        F.col("error"), _member("sql", json_text(F.col("sql"))), _member("returned_rows", "0"), mark,
        _member("message", json_text(F.lit(TRUNCATED_ROWS))),
    )
    error_text = (
        F.when(F.length(error_full) <= budget, error_full).when(F.length(error_marked) <= budget, error_marked)
        .otherwise(minimal("false"))
    )
    text = (
        F.when(F.col("status") == "missing", failed(F.lit(MISSING_SQL)))
        .when(F.col("status") == "not_read_only", failed(F.lit(NOT_READ_ONLY)))
        .when(F.col("status") == "error", error_text)
        .otherwise(ok_text)
    )
    shown = (
        F.when(F.col("status") != "ok", F.lit(0)).when(fits_full, F.col("_n"))
        .otherwise(F.coalesce("_kept", F.lit(0)))
    )
    return shaped.select(*on, "status", shown.alias("returned_rows"), text.alias("payload"))
