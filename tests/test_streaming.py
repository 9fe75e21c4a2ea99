"""Streams that meet stored rows: late duplicates, replays and late statements."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from razao.streaming import loads

LINES = "id bigint, bank_account_id bigint, dedup_key string"
IMPORTS = "id bigint, bank_account_id bigint, statement_balance bigint, statement_balance_date date, created_at timestamp_ntz"


class Feed:
    """A folder that a stream reads, one file of rows a step."""

    def __init__(self, spark, root, schema):
        self.spark, self.schema, self.root = spark, schema, root
        self.source, self.table, self.progress = (str(root / n) for n in ("in", "table", "progress"))
        self.step = 0
        spark.createDataFrame([], schema).write.parquet(f"{self.source}/part=0")

    def send(self, rows, run):
        self.step += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.source}/part={self.step}")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.source}/part=*")
        run(stream, self.table, self.progress).awaitTermination()


@pytest.fixture
def lines(spark, tmp_path):
    feed = Feed(spark, tmp_path, LINES)
    loads.prepare_table(spark, spark.createDataFrame([], LINES).schema, feed.table)
    return feed


def test_lines_load_once_whenever_they_come_back(spark, lines):
    schema = spark.createDataFrame([], LINES).schema
    lines.send([(1, 7, "a"), (2, 7, "a"), (3, 7, "b"), (4, 8, "a")], loads.stream_import)
    lines.send([(5, 7, "c")], loads.stream_import)
    lines.send([(6, 7, "a"), (7, 8, "a"), (8, 8, "d")], loads.stream_import)
    stored = loads.read_table(spark, schema, lines.table)
    assert sorted(r.id for r in stored.collect()) == [1, 3, 4, 5, 8]
    # only the buckets of a batch's own rows hold a folder of it
    placed = {(r.bucket, r.batch) for r in stored.collect()}
    assert len({b for b, batch in placed if batch == max(x for _, x in placed)}) <= 2


def test_a_small_batch_reads_its_own_buckets_only(spark, lines):
    schema = spark.createDataFrame([], LINES).schema
    lines.send([(i, i % 50, f"k{i}") for i in range(2000)], loads.stream_import)
    stored = loads.read_table(spark, schema, lines.table)
    rows = spark.createDataFrame([(9000, 1, "k1"), (9001, 2, "new")], LINES).withColumn("bucket", loads.bucket_of(["bank_account_id", "dedup_key"], loads.BUCKETS))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
    read = stored.where(F.col("bucket").isin(touched))
    assert len(touched) <= 2 and read.count() < 120
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and len(stored.inputFiles()) > 60
    assert {r.bucket for r in read.collect()} <= set(touched)


def test_a_late_statement_does_not_replace_a_newer_balance(spark, tmp_path):
    feed = Feed(spark, tmp_path, IMPORTS)
    schema = loads.newest_declarations(spark.createDataFrame([], IMPORTS)).schema
    loads.prepare_table(spark, schema, feed.table)
    day, at = dt.date, dt.datetime
    feed.send([(1, 7, 500, day(2025, 5, 31), at(2025, 6, 1)), (2, 8, 10, day(2025, 4, 30), at(2025, 5, 1)), (3, 9, None, day(2025, 5, 1), at(2025, 5, 2))], loads.stream_balances)
    feed.send([(4, 7, 100, day(2025, 3, 31), at(2025, 7, 1))], loads.stream_balances)  # a backfill of March
    feed.send([(5, 8, 20, day(2025, 4, 30), at(2025, 5, 2)), (6, 9, 30, None, at(2025, 5, 2))], loads.stream_balances)
    got = {r.bank_account_id: (r.declared_balance, r.declared_date) for r in loads.read_balances(spark, schema, feed.table).collect()}
    assert got == {7: (500, day(2025, 5, 31)), 8: (20, day(2025, 4, 30))}
