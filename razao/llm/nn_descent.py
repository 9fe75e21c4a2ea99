"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. A neighbour graph starts from a few random projections
(each node's neighbours in projected order) and is refined: every node introduces its
best neighbours to each other, and a node keeps its best. A node whose list is full of links
is saturated: its list grows without limit, and it meets the rest of its group at common hubs.
A recall audit compares the lists of a fresh hashed sample of nodes with all nodes of their label,
in blocks, and asks in each degree class how many nodes' lists are whole; refinement goes on until
the audit is passed. Labels whose audit draws every node, and those still open when the rounds run
out, are compared as a whole. Edges at or above the threshold stay.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, have no link and are their own component; vectors of different length
do not link; rows that repeat a vec_id are separate vectors of one id (an id is never counted as
its own component's rival); ties are kept; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from razao.llm.common import components, stored

LOG = logging.getLogger(__name__)
THRESHOLD = 0.93
START = 12  # neighbours of a node at first
PROJECTIONS = 8
MAX_ROUNDS = 12
HUBS = 3
AUDIT_SHARE = 64  # one node in so many is audited,
AUDITED = 400  # and so many of a degree class at least
TARGET = 0.995
BLOCK = 1024


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node table, row table): equal unit vectors of a label are one node, named by a hash."""

    def unit(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
                size = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
                out.append((x / size).tobytes() if size > 0 and np.isfinite(size) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = rows.mapInArrow(unit, "vec_id long, label string, unit binary")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull()
    rows = stored(rows.withColumn("node", F.when(usable, F.xxhash64("label", "unit"))), "vectors")
    grouped = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return stored(grouped, "nodes"), rows


def projected(table: DataFrame, projections: int = PROJECTIONS, per: int = START) -> DataFrame:
    """(a, b) candidate neighbours: nodes next to each other along random directions.

    Rows are range-partitioned by (direction, label, projection), so that a large label is
    spread; neighbours across a partition's edge are left to the refinement.
    """

    def place(batches):
        for batch in batches:
            node, label, units = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            where = []
            for u in units:
                x = np.frombuffer(u)
                rng = np.random.default_rng(len(x))
                where.append(rng.standard_normal((projections, len(x))) @ x)
            for k in range(projections):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(node), pa.int32()), pa.array(label), pa.array([len(u) for u in units], pa.int32()), pa.array([w[k] for w in where]), pa.array(node, pa.int64())], names=["k", "label", "size", "at", "node"])

    def adjoin(batches):
        tail = None
        for batch in batches:
            pdf = batch.to_pandas()
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            group = pd.factorize(pdf["k"].astype(str) + "\0" + pdf["size"].astype(str) + "\0" + pdf["label"])[0]
            node = pdf["node"].to_numpy()
            fresh = len(tail) if tail is not None else 0
            for step in range(1, per // 2 + 1):
                same = group[step:] == group[:-step]
                same[: max(0, fresh - step)] = False
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[:-step][same]), pa.array(node[step:][same])], names=["a", "b"])
            tail = pdf.iloc[-(per // 2) :]

    spread = table.select("node", "label", "unit").mapInArrow(place, "k int, label string, size int, at double, node long")
    ordered = spread.repartitionByRange("k", "label", "size", "at", "node").sortWithinPartitions("k", "label", "size", "at", "node")
    return ordered.mapInArrow(adjoin, "a long, b long")


def scored(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, cos) for distinct unordered pairs, in double precision."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    unit = table.select("node", "unit")
    both = pairs.join(unit.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(unit.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")

    def cosine(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            out = np.array([np.dot(np.frombuffer(p.as_buffer()), np.frombuffer(q.as_buffer())) if len(p.as_buffer()) == len(q.as_buffer()) else -2.0 for p, q in zip(x, y, strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cos"])

    return both.select("a", "b", "x", "y").mapInArrow(cosine, "a long, b long, cos double")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "cos").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))


def in_blocks(members: DataFrame) -> DataFrame:
    """The members of groups with the number of blocks that their group is cut into."""
    return members.join(members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "g")


def introductions(members: DataFrame, table: DataFrame, floors: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, cos) that meet in a group (g, b, fresh, blocks) and could enter a list.

    Each group receives its members' vectors. Large groups are cut into blocks of members and
    every pair of blocks meets in a task of its own. Pairs of two members that are not fresh
    met in an earlier round. A pair that meets in two groups is given twice.
    """
    unit = table.select(F.col("node").alias("b"), "unit").join(floors, "b", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    rows = members.join(unit, "b")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("b", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def meet(batches):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = [rows.column(k).to_numpy() for k in ("g", "i", "j")]
            starts = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])])) if len(rows) else np.zeros(0, int)
            if len(starts) > 1:
                yield from _met(rows.slice(0, int(starts[-1])), starts[:-1], threshold)
            held = rows.slice(int(starts[-1])) if len(starts) else held
        if held is not None and len(held):
            yield from _met(held, np.array([0]), threshold)

    rows = rows.select("g", "i", "j", "b", "unit", "block", "fresh", "floor")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return rows.mapInArrow(meet, "a long, b long, cos double")


def _met(rows: pa.Table, starts: np.ndarray, threshold: float):
    """Pairs of each run of rows that begins at ``starts``."""
    i, j, b, block, fresh, floor = (rows.column(k).to_numpy() for k in ("i", "j", "b", "block", "fresh", "floor"))
    units = rows.column("unit").to_pylist()
    out: list[tuple] = []
    for s, e in zip(starts, [*starts[1:], len(rows)], strict=True):
        by_size: dict[int, list[int]] = {}
        for k in range(s, e):
            by_size.setdefault(len(units[k]), []).append(k)
        for found in by_size.values():
            at = np.array(found)
            left, right = at[block[at] == i[s]], at[block[at] == j[s]]
            if not len(left) or not len(right):
                continue
            x = np.frombuffer(b"".join([units[k] for k in left])).reshape(len(left), -1)
            y = x if i[s] == j[s] else np.frombuffer(b"".join([units[k] for k in right])).reshape(len(right), -1)
            cos = x @ y.T
            keep = (fresh[left][:, None] | fresh[right][None, :]) & (cos >= np.minimum(np.minimum(floor[left][:, None], floor[right][None, :]), threshold))
            keep &= b[left][:, None] < b[right][None, :] if i[s] == j[s] else b[left][:, None] != b[right][None, :]
            r, c = np.nonzero(keep)
            p, q = b[left[r]], b[right[c]]
            out.append((np.minimum(p, q), np.maximum(p, q), cos[r, c]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["a", "b", "cos"])


NO_PAIRS = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "cos": pd.Series([], dtype=float)})


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), float).reshape(len(units), -1)


def _pairs(a: np.ndarray, b: np.ndarray, cos: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(keep)
    return pd.DataFrame({"a": np.minimum(a[r], b[c]), "b": np.maximum(a[r], b[c]), "cos": cos[r, c]})


def gatherings(lists: DataFrame, width: int, threshold: float, turn: int) -> DataFrame:
    """(g, b, fresh, blocks): who meets this round.

    Every node gathers its best ``width`` neighbours. A node whose best are all links is
    saturated; it also goes to the gatherings of a few hubs, the neighbours (or itself) with
    the smallest hashes of the round. Members of a dense group choose the same hubs, so a
    group of m nodes meets a few times and not m times.
    """
    small = lists.where(F.col("r") <= width).select(F.col("a").alias("g"), "b", "fresh", F.lit(-(-width // BLOCK)).alias("blocks"))
    # the last of a saturated list stands for the node itself, too
    last = F.col("r") == width
    known = lists.where(F.col("cos") >= threshold).select("a", last.alias("last"), F.explode(F.when(last, F.array("b", "a")).otherwise(F.array("b"))).alias("b"))
    seeds = [turn * HUBS + k for k in range(HUBS)]
    picks = known.groupBy("a").agg(F.max("last").alias("saturated"), *[F.min(F.struct(F.xxhash64("b", F.lit(s)).alias("h"), "b")).alias(f"m{s}") for s in seeds]).where("saturated")
    large = picks.select(F.explode(F.array(*[F.xxhash64(F.lit(s), f"m{s}.b") for s in seeds])).alias("g"), F.col("a").alias("b"), F.lit(True).alias("fresh"))
    return small.union(in_blocks(large).select("g", "b", "fresh", "blocks"))


def pooled(pairs: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(a, b, cos, ab, ba) of every unordered pair: whether a's list holds b so far, and b's a."""
    held = pairs.select("a", "b", "cos", F.lit(False).alias("ab"), F.lit(False).alias("ba"))
    if lists is not None:
        held = held.union(lists.select(F.least("a", "b"), F.greatest("a", "b"), "cos", F.col("a") < F.col("b"), F.col("a") > F.col("b")))
    return held.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("ab").alias("ab"), F.max("ba").alias("ba"))


def best_lists(edges: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, cos, r, fresh): each node's best ``width`` neighbours, and all links beyond them.

    Links are the result and never cut, so a saturated list grows by as many places as needed.
    ``edges`` are ``pooled``; a neighbour that the list did not hold before is fresh.
    """
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    ends = edges.select("a", "b", "cos", (~F.col("ab")).alias("fresh")).union(edges.select("b", "a", "cos", ~F.col("ba")))
    return ends.withColumn("r", rank).where((F.col("r") <= width) | (F.col("cos") >= threshold)).select("a", "b", "cos", "r", "fresh")


def audit(table: DataFrame, links: DataFrame, threshold: float, given: DataFrame, turn: int, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(missed pairs, (label, dim, recall, whole)): a hashed sample of nodes against all of their label.

    Every turn draws a sample of its own, and pairs that earlier audits have ``given`` to the
    lists do not count, neither as found nor as lost. In each label, nodes are drawn by degree
    class (powers of two of the links found so far), ``least`` of a class at least, or all of
    it. Recall is the share of nodes whose whole list was found, in the worst class of true
    degree, each node weighted by what it stands for; a label none of whose drawn nodes has a
    link was not audited, and its recall is null. ``whole`` says that all nodes were drawn, so that
    the missed pairs are all that the label lacked.

    The nodes of a label are dealt to blocks and its sample to parts, both of bounded size;
    every part meets every block once.
    """
    least = AUDITED if least is None else least
    degree = both_ways(links).groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")
    sized = table.select("node", "label", "unit", F.length("unit").alias("dim")).join(degree, "node", "left")
    sized = sized.withColumn("class", _class(F.coalesce("degree", F.lit(0)))).drop("degree")
    share = F.least(F.greatest(F.floor(F.count("*") / least), F.lit(1)), F.lit(AUDIT_SHARE))
    classes = sized.groupBy("label", "dim", "class").agg(F.count("*").alias("n"), share.cast("int").alias("share"))
    labels = classes.groupBy("label", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("share")).alias("drawn"), F.max("share").alias("most"))
    labels = labels.select("label", "dim", "most", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("drawn") / BLOCK).cast("int").alias("parts"))
    sized = stored(sized.join(classes.drop("n"), ["label", "dim", "class"]).join(labels, ["label", "dim"]), "sized")
    sampled = F.pmod(F.xxhash64("node", F.lit(11), F.lit(turn)), F.col("share")) == 0
    block, part = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    columns = ["label", "dim", "block", "part", "probe", "node", "unit"]
    probes = sized.where(sampled).withColumn("probe", F.lit(True)).withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(columns)
    others = sized.withColumn("probe", F.lit(False)).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(columns)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["probe"]], pdf[~pdf["probe"]]
        if left.empty or right.empty:
            return NO_PAIRS
        cos = _matrix(left["unit"]) @ _matrix(right["unit"]).T
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        return _pairs(a, b, cos, (cos >= threshold) & (a[:, None] != b[None, :]))

    truth = probes.union(others).groupBy("label", "dim", "block", "part").applyInPandas(compare, "a long, b long, cos double")
    truth = truth.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    truth = stored(truth.join(given.select("a", "b"), ["a", "b"], "left_anti"), "audit")
    missed = stored(truth.join(links.select("a", "b"), ["a", "b"], "left_anti"), "missed")
    ends = both_ways(truth.join(missed.select("a", "b", F.lit(True).alias("lost")), ["a", "b"], "left").withColumn("cos", F.coalesce("lost", F.lit(False))))
    judged = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.max("cos").cast("int").alias("lost"))
    judged = judged.join(sized.where(sampled).select("node", "label", "dim", "share"), "node").groupBy("label", "dim", _class(F.col("degree")).alias("class"))
    recall = judged.agg((1 - F.sum(F.col("lost") * F.col("share")) / F.sum("share")).alias("recall")).groupBy("label", "dim").agg(F.min("recall").alias("recall"))
    recall = labels.join(recall, ["label", "dim"], "left").select("label", "dim", "recall", (F.col("most") == 1).alias("whole"))
    return missed, stored(recall, "recall")


def _class(degree: Column) -> Column:
    return F.ceil(F.log2(degree + 1)).cast("int")


def all_links(table: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cos): every link of the labels in ``table``, by comparing all blocks of each."""
    members = table.select(F.xxhash64("label", F.length("unit")).alias("g"), F.col("node").alias("b"), F.lit(True).alias("fresh"))
    links_only = table.select(F.col("node").alias("b"), F.lit(2.0).alias("floor"))
    return introductions(in_blocks(members), table, links_only, threshold)


def near_duplicate_graph(table: DataFrame, threshold: float = THRESHOLD, start: int = START, max_rounds: int = MAX_ROUNDS, target: float = TARGET) -> tuple[DataFrame, float]:
    """(links (a, b, cos) at or over the threshold, recall of the label with the lowest).

    A label is settled by an audit of some of its nodes that reaches ``target``, or one of all of
    them. Labels that are open when the rounds run out are compared exactly.
    """
    width, recall = start, 1.0
    lists = stored(best_lists(pooled(scored(projected(table, per=start), table)), width, threshold), "lists")
    settled = given = lists.select("a", "b", "cos").where("false")
    for turn in range(max_rounds):
        full = lists.where(F.col("r") == width).select(F.col("a").alias("b"), F.col("cos").alias("floor"))
        pool = pooled(introductions(gatherings(lists, width, threshold, turn), table, full, threshold), lists)
        lists = stored(best_lists(pool, width, threshold), "lists")
        grown = not lists.where(F.col("fresh") & (F.col("cos") >= threshold)).isEmpty()
        if grown and turn < max_rounds - 1:
            continue
        links = lists.where((F.col("cos") >= threshold) & (F.col("a") < F.col("b"))).select("a", "b", "cos")
        missed, judged = audit(table, links, threshold, given, turn)
        passed = F.col("whole") | (F.coalesce("recall", F.lit(0.0)) >= target)
        state = judged.agg(F.min(F.when(passed & ~F.col("whole"), F.col("recall"))).alias("recall"), F.count_if(~passed).alias("left")).first()
        recall = min(recall, 1.0 if state.recall is None else state.recall)
        if not state.left:
            return settled.union(links).union(missed), recall
        named = table.withColumn("dim", F.length("unit"))
        done = named.join(judged.where(passed), ["label", "dim"], "left_semi").select(F.col("node").alias("a"))
        settled = settled.union(stored(links.union(missed).join(done, "a", "left_semi").select("a", "b", "cos"), "settled"))
        table = stored(named.join(judged.where(~passed), ["label", "dim"], "left_semi").select(table.columns), "nodes")
        # missed links enter the graph as new neighbours, and lists get longer
        given = given.union(missed)
        width *= 2
        if turn < max_rounds - 1:
            open_nodes = table.select(F.col("node").alias("a"))
            lists = stored(best_lists(pooled(pool.select("a", "b", "cos").union(missed).join(open_nodes, "a", "left_semi")), width, threshold), "lists")
    return settled.union(stored(all_links(table, threshold), "exact")), recall


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every vector."""
    table, rows = nodes(vectors)
    links, recall = near_duplicate_graph(table, threshold)
    LOG.info("lowest recall of a label's audit: %.4f", recall)
    copies = table.select("node", "copies")
    degree = both_ways(links).select(F.col("a").alias("node"), F.col("b").alias("other")).join(copies.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = found.join(table.select("node", "least"), "node")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("node", "component_id")
    per_node = table.select("node", "copies", "least").join(degree, "node", "left").join(named, "node", "left")
    per_node = per_node.select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "node").join(per_node, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))
