"""Helpers the corpus operators share: stored tables, byte-level tokens, fixed-size sketches.

Text columns are handled as UTF-8 in numpy, a few megabytes at a time, so that memory in a
task depends on the longest single text and not on the number of rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.session import checkpoint_dir

CHUNK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, then read back.

    Later steps restart from these files when an executor is lost. The folder is the one of
    ``spark.checkpoint.dir``; each call takes a new table name.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_2``, ``name_3``, ... that no column of ``df`` has."""
    taken, out, n = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def whole(docs: DataFrame) -> Column:
    """All columns in one struct ``row``, so that a stage's own columns meet no name of the table.

    ``select("row.*")`` gives them back.
    """
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def folded(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- texts in numpy


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes (null: empty), about ``limit`` bytes each."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]) if len(values) else np.zeros(0, np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += int(size)
            if held >= limit or i + 1 == len(sizes):
                part = values.slice(start, i + 1 - start)
                yield batch.slice(start, i + 1 - start), [v if v is not None else b"" for v in part.to_pylist()]
                start, held = i + 1, 0


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


STEP = 4096


def _steps(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


SMALL, SMALL_INVERSE = (_steps(b, STEP) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _large(base: int, n: int) -> np.ndarray:
    """Powers of base ** STEP, enough for n positions."""
    return _steps(pow(base, STEP, 1 << 64), n // STEP + 1)


class Texts:
    """Texts side by side in one byte array, a line feed after each."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.bytes = LOWER[raw] if fold else raw
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self._sums: np.ndarray | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word, in order."""
        solid = np.concatenate([[False], ~WHITE[self.bytes], [False]])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line, split at line feeds alone."""
        ends = np.flatnonzero(self.bytes == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        return starts, ends, self.owner(starts)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes in every task."""
        n = len(self.bytes)
        if self._sums is None:
            powers = (_large(BASE, n)[:, None] * SMALL[None, :]).ravel()[:n]
            powers *= BYTE_VALUES[self.bytes]
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(powers, out=self._sums[1:])
        back = _large(pow(BASE, -1, 1 << 64), n)[starts // STEP] * SMALL_INVERSE[starts % STEP]
        value = (self._sums[ends] - self._sums[starts]) * back
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed))

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """Per text the number of bytes for which the 256-entry table holds."""
        sums = np.concatenate([[0], np.cumsum(wanted[self.bytes])])
        return sums[self.starts + self.sizes] - sums[self.starts]


def run_starts(owner: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array changes."""
    if not len(owner):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


# ---------------------------------------------------------------- fixed-size sums


def summed_vector(df: DataFrame, vectors: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, slices: int = 64) -> np.ndarray:
    """The sum over all rows of a vector of fixed length.

    Each task adds up its rows and sends the vector in compressed slices; slices are added in
    two rounds, so no task reads more than a bounded part. The driver gets ``size`` numbers,
    whatever the number of rows.
    """
    width = -(-size // slices)
    schema = "slice int, salt int, v binary"

    def per_task(batches):
        from pyspark import TaskContext

        total = np.zeros(width * slices, np.int64)
        got = vectors(batches)
        total[: len(got)] = got
        salt = TaskContext.get().partitionId() % 64
        parts = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([salt] * slices, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "salt", "v"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for v in pdf["v"]:
            total += np.frombuffer(zlib.decompress(v), np.int64)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "salt": [0], "v": [zlib.compress(total.tobytes(), 1)]})

    parts = df.mapInArrow(per_task, schema)
    parts = parts.groupBy("slice", "salt").applyInPandas(merge, schema)
    parts = parts.groupBy("slice").applyInPandas(merge, schema)
    out = np.zeros(width * slices, np.int64)
    for row in parts.collect():
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(zlib.decompress(row.v), np.int64)
    return out[:size]


# ---------------------------------------------------------------- components


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over the edges (u, v).

    Alternating large-star and small-star rounds. Minima are taken with map-side sums and
    joined back, so a hub's neighbours need not meet in one task. Nodes without an edge to
    another node are not listed.
    """
    current = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    mark = _mark(current)
    while mark[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        )
        current = stored(small, label)
        before, mark = mark, _mark(current)
        if mark == before:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
