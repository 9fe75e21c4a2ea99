"""Continuous forms of the statement load, the declared balances and the change log.

All are safe to repeat: a batch writes folders of its own, so a replayed batch replaces itself.

Tables that a batch is compared with are kept in buckets, by a hash of the account (and key). A batch
only reads the buckets that its own rows fall into; how many rows the others hold does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from razao.operators.balances import newest_declarations
from razao.operators.imports import new_lines

BUCKETS = 64


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, schema: StructType, table: str) -> DataFrame:
    """The stored rows with their ``bucket`` and ``batch``."""
    full = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("batch", IntegerType())])
    return spark.read.schema(full).parquet(table)


def prepare_table(spark: SparkSession, schema: StructType, table: str) -> None:
    """Make an empty table, so that the first batch finds one to compare with."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{table}/bucket=0/batch=-1")


def _write(rows: DataFrame, table: str, epoch: int) -> None:
    """The rows of a batch as its folder in each of their buckets; earlier tries are replaced."""
    placed = rows.withColumn("batch", F.lit(epoch))
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)


def _touched(batch: DataFrame) -> list[int]:
    """The buckets of a batch: at most as many numbers as there are buckets."""
    return [r.bucket for r in batch.select("bucket").distinct().collect()]


def stream_import(lines: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append lines whose (account, dedup key) is not stored, whenever they arrive.

    Duplicates may come months later, so the whole stored key set is the state: an anti join with
    the touched buckets of the table, not a watermark. Of equal keys in a batch the first id stays.
    """
    schema = lines.schema
    key = ["bank_account_id", "dedup_key"]

    def load(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("bucket", bucket_of(key, buckets))
        stored = read_table(batch.sparkSession, schema, table).where(F.col("bucket").isin(_touched(batch)) & (F.col("batch") < epoch))
        first = batch.groupBy(*key).agg(F.min("id").alias("id"))
        fresh = batch.join(first, [*key, "id"], "left_semi")
        _write(new_lines(fresh, stored).select(*schema.names, "bucket"), table, epoch)

    return _run(lines, load, checkpoint)


def stream_balances(imports: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep each account's newest declared balance while imports arrive.

    The newest is the one with the latest balance date, not the one that was imported last: an old
    statement that is loaded late replaces nothing. A batch writes a new version of the buckets it
    touches; ``read_balances`` takes the last version of every bucket.
    """
    schema = newest_declarations(imports).schema

    def load(batch: DataFrame, epoch: int) -> None:
        declared = newest_declarations(batch).withColumn("bucket", bucket_of(["bank_account_id"], buckets))
        held = _versions(read_table(batch.sparkSession, schema, table).where(F.col("bucket").isin(_touched(declared)) & (F.col("batch") < epoch)))
        merged = newest_declarations(declared.drop("bucket").unionByName(held))
        _write(merged.withColumn("bucket", bucket_of(["bank_account_id"], buckets)), table, epoch)

    return _run(imports, load, checkpoint)


def _versions(stored: DataFrame) -> DataFrame:
    """The rows of each bucket's last batch."""
    last = stored.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["bucket", "batch"], "left_semi").drop("bucket", "batch")


def read_balances(spark: SparkSession, schema: StructType, table: str) -> DataFrame:
    """The newest declared balance of every account that has one."""
    rows = _versions(read_table(spark, schema, table))
    return rows.select(
        "bank_account_id", F.col("statement_balance").alias("declared_balance"), F.col("statement_balance_date").alias("declared_date")
    )


def _run(source: DataFrame, load, checkpoint: str) -> StreamingQuery:
    return (
        source.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_audit(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append change rows to the log, one folder per month of the change."""
    return (
        changes.withColumn("month", F.date_format("changed_at", "yyyy-MM"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("month")
        .option("checkpointLocation", checkpoint)
        .option("path", table)
        .trigger(availableNow=True)
        .start()
    )
