"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumql.session import freeze

#: Texts of one step inside a task are taken in slices of about this many bytes.
SLICE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text is divisible by five; rows without a key are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first longer name that no column of ``df`` has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts in ``column`` have about ``most`` bytes together, one row at least."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    first = total = 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(size):
        yield batch.slice(first)


def map_texts(df: DataFrame, text: str, function, schema: T.StructType | str) -> DataFrame:
    """``function(rows: RecordBatch) -> RecordBatch`` over byte-bounded slices of every partition."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield function(part)

    return df.mapInArrow(run, schema)


def add_columns(rows: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *columns.values()], [*rows.schema.names, *columns])


class Lexicon(dict):
    """Numbers for the distinct tokens met, and a row of figures for each, worked out for many new tokens at once.

    ``make(tokens)`` gives the rows of new tokens. ``trim`` forgets everything once more than ``most`` tokens or
    ``most_chars`` characters of them are held, so memory stays bounded whatever the number and length of texts.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], most: int = 200_000, most_chars: int = 8 << 20) -> None:
        super().__init__()
        self.make, self.most, self.most_chars, self.chars, self.new, self.held = make, most, most_chars, 0, [], None

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        self.chars += len(token)
        return number

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def rows(self) -> np.ndarray:
        """One row for each number given so far."""
        if self.new or self.held is None:
            more = self.make(self.new)
            self.held = more if self.held is None else np.concatenate([self.held, more])
            self.new = []
        return self.held

    @property
    def full(self) -> bool:
        return len(self) > self.most or self.chars > self.most_chars

    def trim(self) -> None:
        if self.full:
            self.clear()
            self.chars, self.new, self.held = 0, [], None


def gram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of ``<word>`` and, with ``whole``, of each word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = np.uint64(0x9E3779B97F4A7C15)

    def bucket(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)

    for n in sizes:
        if len(codes) < n:
            continue
        mixed = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = (mixed + codes[k : len(codes) - n + 1 + k]) * step
        inside = owner[: len(mixed)] == owner[n - 1 :]
        owners.append(owner[: len(mixed)][inside])
        found.append(bucket(mixed[inside]))
    if whole:
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        power = np.cumprod(np.full(int(lengths.max()), step, dtype=np.uint64))
        owners.append(np.arange(len(words)))
        found.append(bucket(np.add.reduceat(codes * power[place], starts)))
    return np.concatenate(owners), np.concatenate(found)


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int, most_labels: int = 256, most_rows: int = 50_000) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each value of ``label`` (all, if there are fewer), and the row count of each value.

    A row is taken if the hash of its key, as a fraction, lies below ``per_class`` over its label's count, so only counts
    are shuffled. Of more than ``most_labels`` values the most frequent are learned; many values share ``most_rows``. The
    rows are limited to twice the aim.
    """
    counts = {row[0]: row[1] for row in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    per_class = max(1, min(per_class, most_rows // max(1, len(counts))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), 11) / F.lit(float(1 << 53))
    kept = F.lit(False)
    for value, n in counts.items():
        kept = kept | (F.col(label).eqNullSafe(F.lit(value)) & (place < F.lit(per_class / n)))
    return rows.filter(kept).limit(2 * per_class * max(1, len(counts))), counts


def tagged(df: DataFrame, wanted: str = "row") -> tuple[DataFrame, str]:
    """``df`` with a number for each row. Another reading may number rows otherwise, since the splits of files depend on
    the cores at that time: numbers that are joined must come from one table written once."""
    name = free_name(df, wanted)
    return df.withColumn(name, F.monotonically_increasing_id()), name


def keep_rows(docs: DataFrame, choose: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of ``docs`` whose numbers are in the one column of ``choose(numbered rows, name of the number)``.

    The numbered rows are written once, and both sides of the join read them from there.
    """
    own, name = tagged(docs)
    own = freeze(own, "numbered")
    return own.join(choose(own, name).toDF(name), name, "left_semi").select(*docs.columns)
