"""What each filter removes, in every order in which the filters could be applied.

A document becomes a mask of the filters it fails. Documents are counted in cells of (part, mask),
with the good and the toxic ones among them; a part has 32 cells at most for five filters,
whatever the number of its documents. Each cell is folded once along every order with
``aggregate`` inside ``transform``: the fold carries whether the cell is gone and emits one
struct a step, weighted with the cell's counts. The 600 structs of a part's cells are merged by
sums of their elements.

The order array holds all permutations of the filter letters and is a constant of the plan.

"Identical to a smaller document's text" needs the smallest id of each text. Rows are counted by
(digest, id) first, then by (digest, part, labels) with the smallest id and its rows, so a text
that a third of the table holds shrinks to a few rows before its cells meet. No row is joined
back to its copies.

Defined results: null and empty texts are texts without words and equal each other; a null
language and the empty one are the same part; a null id is neither smaller than another nor
does another precede it, and it has no label; rows that share an id do not precede each other; an id with several
label rows is good (toxic) if one of them says so, without one it is neither; an empty table
has no parts; other columns take no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from razao.llm.common import stored

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
MARKS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone, by filter letter."""
    words = F.regexp_count(text, F.lit(WORDS)).cast("long")
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, SPACES)), "")).cast("long")
    capitals = (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long")
    return {
        "A": words < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * words,
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def mask_of(failures: dict[str, Column]) -> Column:
    """Bit i is set where the i-th filter fails."""
    out = F.lit(0)
    for i, fails in enumerate(failures.values()):
        out = out.bitwiseOR(F.when(fails, 1 << i).otherwise(0))
    return out


def mask_cells(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, mask, rows, good, toxic), and the filter letters in the order of the bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failures = text_failures(F.col("body"))
    letters = "".join(failures) + COPY
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), mask_of(failures).alias("mask"))
    rows = stored(rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("rows")), "masks")
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without an id have no label and meet no other row: they skip both steps below
    named = rows.where("id IS NOT NULL").join(marks, "id", "left").fillna(0, ["good", "toxic"])
    nameless = rows.where("id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.col("rows").alias("firsts"), F.lit(0).cast("long").alias("copies"))
    groups = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("rows").alias("rows"), F.min(F.struct("id", "rows")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.id") == least, F.col("first.rows")).otherwise(0)
    judged = groups.withColumn("firsts", firsts).select("part", "mask", "good", "toxic", "firsts", (F.col("rows") - F.col("firsts")).alias("copies"))
    bit = 1 << (len(letters) - 1)
    halves = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit)).alias("mask"), F.col("copies").alias("n")))
    split = judged.unionByName(nameless).select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    cells = split.groupBy("part", "mask").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    return cells, letters


def folded_orders(letters: str) -> Column:
    """Of a cell (mask, rows, good, toxic): one struct for each order and step."""
    orders = F.lit(["".join(p) for p in permutations(letters)])
    none = F.lit(0).cast("long")
    kind = "array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"

    def along(order: Column) -> Column:
        def step(state: Column, letter: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
            fails = F.col("mask").bitwiseAND(bit) != 0
            gone = state["gone"]
            here = fails & ~gone
            counts = (
                F.when(gone | fails, none).otherwise(F.col("rows")), F.when(here, F.col("rows")).otherwise(none),
                F.when(fails & gone, F.col("rows")).otherwise(none), F.when(F.col("mask") == bit, F.col("rows")).otherwise(none),
                F.when(here, F.col("good")).otherwise(none), F.when(here, F.col("toxic")).otherwise(none),
            )
            row = F.struct(order.alias("filter_order"), (F.size(state["out"]) + 1).alias("step"), letter.alias("letter"), *[c.alias(n) for c, n in zip(counts, COUNTS, strict=True)])
            return F.struct((gone | fails).alias("gone"), F.concat(state["out"], F.array(row)).alias("out"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.split(order, ""), start, step, lambda state: state["out"])

    return F.flatten(F.transform(orders, along))


def order_audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order and step, with the Shapley sum of the step's filter."""
    steps = cells.select("part", F.inline(folded_orders(letters)))
    merged = steps.groupBy("part", "filter_order", "step", "letter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return merged.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents."""
    return order_audit(*mask_cells(docs, labels))


ORACLE = r"""
WITH label AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), judged AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > least, false)] AS fails
  FROM judged d LEFT JOIN label l ON l.doc_id = d.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, fails
), letters(l) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM orders, range(1, 6) t(step)
), placed AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[ascii(letter) - 64] AS here,
         len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i::INT, 1)) - 64])) > 0 AS gone,
         len(list_filter(fails, lambda f: f)) AS failing
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE here AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE here AND failing = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
