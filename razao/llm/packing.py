"""Best-fit packing of documents into fixed token windows, with conflicts.

Documents longer than a window are cut; full windows stand alone. The other pieces are dealt by
hash to shards of bounded size and packed longest first. A shard's open bins are ordered by
their free room and carry bitmaps of their sources (one plane per allowed piece) and of
their duplicate clusters. The search starts at the first bin with enough room and goes on to
the next larger until a bin without conflict is found; only then is a new bin opened.

Defined results: null and empty texts make one piece of length 0; a null source is a source of
its own; documents with equal folded text are one cluster; ties go by doc_id and piece;
repeated rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.llm.common import folded, stored

CAPACITY = 2048
PER_SOURCE = 4
SHARD_PIECES = 2048
SCHEMA = "doc_id long, piece int, source string, cluster long, n_tokens long, bin_id long, bin_offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, source, cluster, n_tokens): windows of at most ``capacity`` tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(folded(text)).alias("cluster"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int")
    return sized.select("doc_id", "source", "cluster", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", "source", "cluster", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * F.lit(capacity)).alias("n_tokens")
    )


def pack_shard(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for items of (length, source number, cluster number), in their order.

    Bins lie in a list ordered by (free room, bin). Planes of source bits: plane k has the
    sources of which the bin holds more than k pieces.
    """
    order: list[tuple[int, int]] = []
    planes: list[list[int]] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s_bit, c_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (planes[b][-1] & s_bit or clusters[b] & c_bit):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(planes)
            planes.append([0] * per_source)
            clusters.append(0)
        out.append((b, capacity - room))
        carry = s_bit
        for k in range(per_source):
            held = planes[b][k] & carry
            planes[b][k] |= carry
            carry = held
            if not carry:
                break
        clusters[b] |= c_bit
        insort(order, (room - length, b))
    return out


def best_fit(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The bin and the place in it of every piece of every document."""
    parts = stored(pieces(docs, capacity), "pieces")
    shards = max(1, -(-parts.where(F.col("n_tokens") < capacity).count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        source = pdf["source"].astype(object).where(pdf["source"].notna(), "\0none").factorize(sort=True)[0]
        numbers, counts = pdf["cluster"].factorize()[0], pdf["cluster"].value_counts()
        again = pdf["cluster"].map(counts).to_numpy() > 1
        items = [(int(n), int(s), int(c) if a else -1) for n, s, c, a in zip(pdf["n_tokens"], source, numbers, again, strict=True)]
        placed = pack_shard(items, capacity, per_source)
        base = int(pdf["shard"].iloc[0]) << 24
        pdf["bin_id"] = [base + b for b, _ in placed]
        pdf["bin_offset"] = [o for _, o in placed]
        return pdf[["doc_id", "piece", "source", "cluster", "n_tokens", "bin_id", "bin_offset"]]

    short = parts.where(F.col("n_tokens") < capacity).withColumn("shard", shard)
    packed = short.groupBy("shard").applyInPandas(pack, SCHEMA)
    # a full window is a bin of its own: negative numbers, from the row's identity
    whole = parts.where(F.col("n_tokens") == capacity).select(
        "doc_id", "piece", "source", "cluster", "n_tokens",
        (-1 - F.monotonically_increasing_id()).cast("long").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"),
    )
    return packed.unionByName(whole)
