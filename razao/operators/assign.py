"""One-to-one assignment in quality order, and ranks inside large groups.

The reference takes candidate pairs best first and locks each one whose two sides are free.
Under one strict total order that result is unique, and it can be found without a sequential
pass: a pair that is the best left for *both* its sides will be taken by the scan in any
case, so all such pairs can be taken at once, their sides reduced, and the step repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from razao.session import cut_lineage, forget

# Rows of one group that one sort may hold. Larger groups are cut into slices of the id.
SLICE_BITS = 17


def id_slice(identifier: Column, kind: str) -> Column:
    """A monotone slice of an id: integers by 2^17, text by its first three characters.

    Ids are unique, so a slice of an integer id holds at most 2^17 rows.
    """
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.shiftright(identifier.cast("bigint"), SLICE_BITS).cast("string")
    return F.substring(identifier, 1, 3)


def rank_in_group(rows: DataFrame, keys: list[str], identifier: str = "id") -> DataFrame:
    """Add ``rank`` (0-based, by id) inside each group without sorting a group in one task.

    Rows are ranked inside (group, id slice); slice sizes, a few rows per group, are summed
    to the offset of each slice.
    """
    kind = dict(rows.dtypes)[identifier]
    order = F.col("_slice").cast("bigint") if kind.endswith("int") else F.col("_slice")
    sliced = rows.withColumn("_slice", id_slice(F.col(identifier), kind))
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(identifier)
    return (
        sliced.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn("rank", F.col("_offset") + F.col("_place") - 1)
        .drop("_slice", "_place", "_offset")
    )


def running_sums(
    rows: DataFrame, keys: list[str], order: list[str], part: str, sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums per group in ``order``, without one sort per group.

    ``part`` names a column that never decreases along ``order`` (a month, an hour): sums run
    inside (group, part), and the totals of earlier parts, a few rows per group, are added.
    """
    inside = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = rows.groupBy(*keys, part).agg(
        *[F.sum(value).alias(f"_{name}_part") for name, value in sums.items()]
    )
    offsets = totals.select(
        *keys,
        part,
        *[F.coalesce(F.sum(f"_{n}_part").over(before), zero).alias(f"_{n}_before") for n in sums],
    )
    # Null-safe on the keys: a null group is a group.
    joined = rows.withColumns(
        {f"_{n}_inside": F.coalesce(F.sum(v).over(inside), zero) for n, v in sums.items()}
    )
    names = [*keys, part]
    right = offsets.select(
        *[F.col(c).alias(f"_k_{c}") for c in names], *[f"_{n}_before" for n in sums]
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names])
    return (
        joined.join(right, match)
        .withColumns({n: F.col(f"_{n}_inside") + F.col(f"_{n}_before") for n in sums})
        .drop(*[f"_k_{c}" for c in names], *[f"_{n}_{x}" for n in sums for x in ("inside", "before")])
    )


def assign_classes(pairs: DataFrame) -> DataFrame:
    """Greedy assignment between classes of interchangeable rows.

    ``pairs`` has ``left_id``, ``right_id``, ``left_count``, ``right_count`` (members of each
    class) and ``quality``, a struct that sorts the best pair first and is a strict order among
    the pairs of a class. It travels with every pair, so it should hold numbers, not texts.
    Returns ``left_id``, ``right_id``, ``left_from``, ``right_from`` and ``taken``: members
    ``left_from …`` of the left class go to members ``right_from …`` of the right one.

    A round deals the pairs by left class and by right class, once each, and writes one table:
    the mutual best pairs and the pairs whose right class has members left. Which left classes
    are used up is seen when the next round deals by left class. At least one class is used up
    per mutual best pair, and most are in the first rounds. A task holds the pairs of a class,
    never those of a group. The rounds run until no pair is left.
    """
    by_left, by_right = W.partitionBy("left_id"), W.partitionBy("right_id")
    fixed = ["left_id", "right_id", "left_count", "right_count"]
    zero = F.lit(0)
    state = pairs.select(
        *fixed,
        F.col("left_count").alias("left_left"),
        F.col("right_count").alias("right_left"),
        "quality",
    )
    rounds: list[DataFrame] = []
    while True:
        mutual = F.col("_best") & (F.col("quality") == F.min("quality").over(by_right))
        taken = F.when(F.col("_mutual"), F.least("left_left", "right_left"))
        written = cut_lineage(
            state.withColumn("_best", F.col("quality") == F.min("quality").over(by_left))
            .withColumn("_mutual", mutual)
            .withColumn("taken", taken)
            .withColumn("_used", F.coalesce(F.max("taken").over(by_right), zero))
            .where(F.col("_mutual") | (F.col("right_left") > F.col("_used")))
            .select(
                *fixed,
                "left_left",
                F.when(F.col("_mutual"), F.col("right_left"))
                .otherwise(F.col("right_left") - F.col("_used"))
                .alias("right_left"),
                F.when(~F.col("_mutual"), F.col("quality")).alias("quality"),
                "taken",
            )
        )
        rounds.append(
            written.where(F.col("taken").isNotNull()).select(
                "left_id",
                "right_id",
                (F.col("left_count") - F.col("left_left")).alias("left_from"),
                (F.col("right_count") - F.col("right_left")).alias("right_from"),
                "taken",
            )
        )
        if written.where(F.col("taken").isNull()).isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        state = (
            written.withColumn("_used", F.coalesce(F.max("taken").over(by_left), zero))
            .where(F.col("taken").isNull() & (F.col("left_left") > F.col("_used")))
            .select(
                *fixed, (F.col("left_left") - F.col("_used")).alias("left_left"), "right_left", "quality"
            )
        )


def greedy_in_group(pairs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same assignment for small groups in one pass, on the JVM.

    ``order`` names columns of ``pairs``, best first when ascending, among them ``line_id``
    and ``transaction_id``, so that the order is strict. The caller bounds the pairs of a group, so the sorted array of one group is
    small, and the aggregate that carries the used ids stays cheap.
    """
    element = F.struct(*order)
    kinds = dict(pairs.dtypes)
    line_type, txn_type = kinds["line_id"], kinds["transaction_id"]
    start = F.struct(
        F.array().cast(f"array<{line_type}>").alias("lines"),
        F.array().cast(f"array<{txn_type}>").alias("transactions"),
    )

    def step(done: Column, pair: Column) -> Column:
        free = ~F.array_contains(done["lines"], pair["line_id"]) & ~F.array_contains(
            done["transactions"], pair["transaction_id"]
        )
        return F.struct(
            F.when(free, F.array_append(done["lines"], pair["line_id"]))
            .otherwise(done["lines"])
            .alias("lines"),
            F.when(free, F.array_append(done["transactions"], pair["transaction_id"]))
            .otherwise(done["transactions"])
            .alias("transactions"),
        )

    return (
        pairs.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(element)).alias("_pairs"))
        .select(*keys, F.aggregate("_pairs", start, step).alias("_done"))
        .select(*keys, F.explode(F.arrays_zip("_done.lines", "_done.transactions")).alias("_m"))
        .select(
            *keys,
            F.col("_m.lines").alias("line_id"),
            F.col("_m.transactions").alias("transaction_id"),
        )
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (u, v).

    Alternating large-star and small-star rounds, a logarithmic number of them even for a chain.
    Minima are taken with map-side sums and joined back, so a hub's neighbours need not meet in one
    task. Nodes without an edge to another node are not listed.
    """
    current = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
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
        after = cut_lineage(small)
        forget(current)
        before, current, mark = mark, after, _mark(after)
        if mark == before:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
