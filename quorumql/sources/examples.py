"""Question files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quorumql.session import freeze

# Field names and defaults of question records.
TEXT_FIELDS = {"question_id": "-1", "evidence": "", "difficulty": "unknown"}
REQUIRED_FIELDS = ("db_id", "question", "SQL")
_RAW = "question_id string, db_id string, question string, evidence string, SQL string, difficulty string"
_RAW_FIELDS = ", ".join(":".join(field.split()) for field in _RAW.split(", "))


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"question record without {name}")).cast("string"))


def _examples(raw: DataFrame, index: Column) -> DataFrame:
    return raw.select(
        index.cast("bigint").alias("index"),
        F.coalesce("question_id", F.lit(TEXT_FIELDS["question_id"])).cast("bigint").alias("question_id"),
        _required("db_id").alias("db_id"),
        _required("question").alias("question"),
        F.coalesce("evidence", F.lit(TEXT_FIELDS["evidence"])).alias("evidence"),
        _required("SQL").alias("gold_sql"),
        F.coalesce("difficulty", F.lit(TEXT_FIELDS["difficulty"])).alias("difficulty"),
    )


def _missing(text: Column, signs: str) -> Column:
    """How many of ``signs`` the text holds."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(place, record text) of every object of one file that holds one JSON array of objects; the file is read by many tasks.

    The file is read in pieces that end at a closing brace, so tasks can start anywhere. What a piece does depends on
    whether it starts inside a string, which only the text before it can tell; so each byte block is summed up for both
    cases (does it turn inside to outside, and by how much does the depth of brackets change), a running sum over the
    blocks, one row each, gives every block its true start, and then every piece its depth. A record ends with the
    brace that brings the depth back to one. What stands between records has to be one comma, and the array has to be
    whole; anything else is an error. Escaped signs are set aside first; no escape ends a piece, as a backslash before
    a brace is not JSON.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    if len(raw.inputFiles()) != 1:
        raise ValueError(f"one file with a JSON array is expected at {path}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(bare, '"')

    def change(start: int) -> Column:
        """Change of depth before the closing brace, if text outside strings is every second part from ``start`` on."""
        kept = F.filter(parts, lambda _, i: i % 2 == start)
        return F.aggregate(kept, F.lit(0), lambda n, p: n + _missing(p, "{[") - _missing(p, "]"))

    pieces = raw.select(
        F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("seq"), "value",
        ((F.size(parts) - 1) % 2).alias("turns"), change(0).alias("from_outside"), change(1).alias("from_inside"))
    # Blocks and numbers depend on how the file was split this time, so they are written down before they are used.
    pieces = freeze(pieces, "pieces")
    last = pieces.orderBy(F.desc("block"), F.desc("seq")).select("block", "seq", "value").first()
    if last is None:
        raise ValueError(f"{path} is empty; a JSON array is expected")
    closed = (F.col("block") < last.block) | (F.col("seq") < last.seq)
    inside_block = Window.partitionBy("block").orderBy("seq")
    before = inside_block.rowsBetween(Window.unboundedPreceding, -1)
    entered = pieces.withColumn("closed", closed.cast("int")).withColumn("odd", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)

    def steps(state: Column) -> Column:
        """Change of depth over the piece, its closing brace included, if it starts in ``state`` (1: inside a string)."""
        ends_outside = (state + F.col("turns")) % 2 == 0
        return F.when(state == 0, F.col("from_outside")).otherwise(F.col("from_inside")) - F.when(ends_outside, F.col("closed")).otherwise(0)

    both = entered.withColumns({"steps0": steps(F.col("odd")), "steps1": steps(1 - F.col("odd"))})
    blocks = both.groupBy("block").agg(F.sum("turns").alias("turns"), F.sum("steps0").alias("steps0"), F.sum("steps1").alias("steps1"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of the file
    blocks = blocks.withColumn("start", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("steps", F.when(F.col("start") == 0, F.col("steps0")).otherwise(F.col("steps1")))
    blocks = blocks.select("block", "start", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("depth"))
    state = (F.col("odd") + F.col("start")) % 2
    through = inside_block.rowsBetween(Window.unboundedPreceding, 0)
    deep = both.join(blocks, "block").withColumn("step", F.when(F.col("start") == 0, F.col("steps0")).otherwise(F.col("steps1")))
    deep = deep.withColumn("depth", F.col("depth") + F.sum("step").over(through))
    ends = (F.col("closed") == 1) & ((state + F.col("turns")) % 2 == 0) & (F.col("depth") == 1)
    marked = deep.select("block", "seq", "value", "closed", ends.cast("int").alias("ends"))
    counted = marked.groupBy("block").agg(F.sum("ends").alias("ends"))
    counted = counted.select("block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"))
    placed = marked.join(counted, "block").withColumn("place", F.col("before") + F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # The text after the last record makes a group of its own, which has no end.
    whole = placed.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"), F.max("ends").alias("ended"))
    text = F.array_join("parts.value", "}")
    gap = F.regexp_extract(text, r"^[^{]*", 0)
    expected = F.when(F.col("place") == 0, gap.rlike(r"^\s*\[\s*$")).otherwise(gap.rlike(r"^\s*,\s*$"))
    rest = F.when(F.col("place") == 0, text.rlike(r"^\s*\[\s*\]\s*$")).otherwise(text.rlike(r"^\s*\]\s*$"))
    fine = F.when(F.col("ended") == 1, expected).otherwise(rest)
    record = F.when(fine, F.concat(F.substring(text, F.length(gap) + 1, F.length(text)), F.lit("}"))).otherwise(
        F.raise_error(F.concat(F.lit("no whole JSON array of objects: error at or after record "), F.col("place").cast("string"))).cast("string"))
    return whole.select("place", record.alias("record"), "ended").where("record IS NOT NULL AND ended = 1").select("place", "record")


def read_examples(spark: SparkSession, path: str, fmt: str = "json_array") -> DataFrame:
    """Question records with their ``index``.

    ``json_array`` is one file holding one JSON array; the index is the place in it. The file is read by as many tasks as
    its bytes are split into. ``jsonl`` and ``parquet`` carry an ``index`` field; ``json_arrays`` is a folder with subfolders
    ``first=N``, each of one file holding the array of the records from index N on, parsed one by one. Missing optional
    fields get their defaults; a missing required one is an error, as are a missing file, several files and broken JSON.
    """
    if fmt == "json_array":
        parsed = F.from_json("record", f"struct<{_RAW_FIELDS}>", {"mode": "FAILFAST"})
        raw = json_array_records(spark, path).select("place", parsed.alias("_record")).select("place", "_record.*")
        return _examples(raw, F.col("place"))
    if fmt == "json_arrays":
        files = spark.read.schema("value string, first bigint").text(path, wholetext=True)
        parsed = F.from_json("value", f"array<struct<{_RAW_FIELDS}>>", {"mode": "FAILFAST"})
        raw = files.select("first", F.posexplode(parsed).alias("_place", "_record")).select("first", "_place", "_record.*")
        return _examples(raw, F.col("first") + F.col("_place"))
    if fmt == "jsonl":
        return _examples(spark.read.schema(f"index bigint, {_RAW}").option("mode", "FAILFAST").json(path), F.col("index"))
    if fmt == "parquet":
        return _examples(spark.read.parquet(path).withColumn("question_id", F.col("question_id").cast("string")), F.col("index"))
    raise ValueError(f"unknown example format {fmt!r}")
