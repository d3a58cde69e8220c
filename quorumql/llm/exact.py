"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

A text is normalised (A-Z in lower case; null counts as empty) and cut where its content says: a chunk ends at the first
sentence or line end after ``least`` characters, or after ``most`` characters if none comes. A chunk's key is a 64-bit
hash. Keys are *verified*: the distinct pairs of key and chunk text are counted once over the corpus, and a key with
several texts is told apart by the rank of the text. A document is then its recipe, the ordered list of verified
identifiers, and documents are equal exactly if their recipes are. Texts move once, as distinct chunks; the comparison
moves recipes, about one number for every 300 characters.

Of equal texts the row with the largest key stays; of fully equal rows exactly one. Rows with a null key are the
smallest. Recipes are written once to the shared folder, so row numbers are data from then on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumql.llm.common import ascii_lower, keep_rows, tagged
from quorumql.session import freeze

LEAST, MOST = 256, 2048


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:[.!?\\n]|\\z)|.{{1,{most}}}"), F.lit(0))


def chunk_key(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id", hashed: Callable[[Column], Column] = chunk_key,
            least: int = LEAST, most: int = MOST, row: str | None = None) -> DataFrame:
    """Row number, key, digest and recipe (chunk keys, and ranks where a key has several texts) of each row of a stored table.

    ``row`` names a column of numbers written before; without it rows are numbered here.
    """
    docs, row = (docs, row) if row else tagged(docs)
    numbered = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    cut = numbered.select("row", chunks(F.col("text"), least, most).alias("chunks"))
    pairs = cut.select(F.explode("chunks").alias("chunk")).select(hashed(F.col("chunk")).alias("id"), "chunk").distinct()
    mixed = freeze(pairs.groupBy("id").count().filter("count > 1").select("id"), "mixed")
    hit = not mixed.isEmpty()
    if hit:  # ranks are joined by row number
        numbered = freeze(numbered, "numbered")
        cut = numbered.select("row", chunks(F.col("text"), least, most).alias("chunks"))
    plain = numbered.select("row", "key", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                            F.transform(chunks(F.col("text"), least, most), hashed).alias("recipe"))
    if not hit:
        return freeze(plain.withColumn("ranks", F.array().cast("array<int>")), "recipes")
    # Only chunks under a key with several texts are looked at again.
    met = cut.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", hashed(F.col("chunk"))).join(mixed, "id")
    texts = met.select("id", "chunk").distinct()
    rank = texts.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    ranks = met.join(rank, ["id", "chunk"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("found"))
    ranks = ranks.select("row", F.col("found.rank").alias("ranks"))
    return freeze(plain.join(ranks, "row", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>"))), "recipes")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row for each row of ``docs``: its number and key, the key that stays, group size, kept or not, and digest."""
    found = recipes(docs, text, key, **options)
    groups = found.groupBy("recipe", "ranks").agg(F.max(F.struct("key", "row")).alias("stays"), F.count("*").alias("group_size"))
    return found.join(groups, ["recipe", "ranks"]).select(
        "row", "key", F.col("stays.key").alias("keep_key"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return keep_rows(docs, lambda own, row: exact_groups(own, row=row).filter("kept").select("row"))
