"""Rendezvous hashing of record keys over weighted shards.

A record goes to the shard with the largest score ``weight / -ln(u)``, where ``u`` is a draw in
(0, 1) from the digest of key and shard number. A shard's score for a key never depends on the
other shards: one more shard only takes records into itself, one less only gives its own away,
and a changed weight only moves records into or out of that shard. The law is ``key``: record
key, shard numbers and weights decide, nothing else does.

Placing is one projection of the row, without a shuffle. Slots number the rows of a shard without
gaps, in the order of (digest of the key, key, size, checksum). Equal rows are counted before
the shuffle and spread again after it, and a shard is numbered in slices of the digest's range
whose sizes are summed first, so neither a hot key nor a shard has to fit in one task.
``write_shards`` writes whole rows to one folder a shard.

DataFrame functions only.

Defined results: a null key is the empty key and has one shard; null text has size 16 and
checksum 0, like the empty text; rows with the same key share a shard, equal rows get different
slots; an empty table gives no rows; columns added to a table that already holds such a name
get the first free name ``shard_2``, ``shard_3``, and other columns pass through; shards with
weight 0 take nothing; no positive weight is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from razao.llm.common import free_name, stored

SHARDS = 40
OVERHEAD = 16
SLICE_ROWS = 200_000
RUN = 10_000
DIGITS = 13  # hexadecimal digits of a draw: 52 bits
UNIT = float(16**DIGITS)


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(text: Column) -> Column:
    """52 bits of the text's digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def placed(key: Column, weights: Sequence[float]) -> Column:
    """The shard number that wins the key; of equal scores the larger number."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = key_text(key)

    def score(weight: Column, shard: Column) -> Column:
        u = (draw(F.concat(text, F.lit(":"), shard.cast("string"))).cast("double") + 0.5) / F.lit(UNIT)
        return F.struct((weight / -F.ln(u)).alias("score"), shard.alias("shard"))

    scores = F.transform(F.lit([float(w) for w in weights]), score)
    return F.array_max(scores)["shard"].cast("int")


def with_shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` and the shard of each row, in a column that has ``name`` or the next free one."""
    return docs.withColumn(free_name(docs, name), placed(F.col(f"`{key}`"), weights))


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id") -> DataFrame:
    """(from_shard, to_shard, rows) of the records that a change of shards moves."""
    both = docs.select(placed(F.col(f"`{key}`"), before).alias("from_shard"), placed(F.col(f"`{key}`"), after).alias("to_shard"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))


def slots(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of every row of ``docs``.

    ``grown_shard`` is the shard with one more of weight 1 behind the others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    counted = counted.select(
        "*", draw(key_text(F.col("doc_id"))).alias("place"), placed(F.col("doc_id"), weights).alias("shard"),
        placed(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"),
    )
    counted = stored(counted, "placed")
    slices = max(1, -(-counted.count() // (len(weights) * slice_rows)))
    counted = counted.withColumn("slice", F.floor(F.col("place") * F.lit(slices) / F.lit(UNIT)).cast("long"))
    totals = counted.groupBy("shard", "slice").agg(F.sum("copies").alias("held"))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("slice")) - F.col("held")
    offsets = totals.select("shard", "slice", before.alias("offset"))
    order = Window.partitionBy("shard", "slice").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    first = counted.withColumn("first", F.sum("copies").over(order) - F.col("copies")).join(offsets, ["shard", "slice"])
    first = first.withColumn("first", F.col("first") + F.col("offset"))
    # copies are spread in runs of a fixed length, each run from a row of its own
    last = F.col("first") + F.col("copies") - F.lit(1)
    runs = first.withColumn("begin", F.explode(F.sequence(F.col("first"), last, F.lit(RUN))))
    many = runs.where(F.col("copies") > RUN).repartition("shard", "begin")
    runs = runs.where(F.col("copies") <= RUN).unionByName(many)
    stop = F.least(F.col("begin") + F.lit(RUN - 1), F.col("first") + F.col("copies") - F.lit(1))
    return runs.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.explode(F.sequence(F.col("begin"), stop)).alias("slot"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", file_rows: int = SLICE_ROWS) -> str:
    """Whole rows as Parquet below ``path``, one folder a shard; the name of the folder column.

    Rows of a shard are dealt by their number in the scan over as many tasks as files are wanted,
    so that equal rows and hot keys are spread as well; the deal only sets the file. ``docs`` is a
    table as it is read, so that a task that runs again deals its rows as before.
    """
    name = free_name(docs, "shard")
    placed_docs = docs.withColumn(name, placed(F.col(f"`{key}`"), weights))
    files = max(1, -(-docs.count() // (len(weights) * file_rows)))
    salt = free_name(placed_docs, "salt")
    dealt = placed_docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(len(weights) * files, name, salt).drop(salt).write.partitionBy(name).parquet(path)
    return name


def sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of the query: placement by key over equal shards, with slots."""
    return slots(docs, (1.0,) * shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = r"""
WITH RECURSIVE step(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), sized AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS bytes FROM documents
), summed AS (
  SELECT doc_id, key, octet_length(bytes) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM sized, crc
), scored AS (
  SELECT *, ('0x' || substr(md5(key), 1, 13))::BIGINT AS place,
         list_transform(range(41), lambda s: 1.0 / -ln((('0x' || substr(md5(key || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS scores
  FROM summed
), placed AS (
  SELECT *, list_position(scores[1:40], list_max(scores[1:40])) - 1 AS shard, list_position(scores, list_max(scores)) - 1 AS grown_shard
  FROM scored
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM placed
"""
