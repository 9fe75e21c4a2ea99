"""Mixing sources to target weights by iterative proportional fitting.

Documents are cells of (source, language, topic). Token weights of the cells are raked in turn
to target marginals of each of the three, a fixed number of rounds; the sums of a round are added
up on the map side and joined to the cells. Documents are then drawn with
probability min(1, c * raked weight / tokens) of their cell, where c is solved so that the
expected tokens equal the budget. Drawing compares a hash of the id with the probability, so
it needs no state and gives the same sample on every run. DataFrame functions only.

Targets are tempered shares of the table's own tokens: share ** power, scaled to 1.

Defined results: null source or language is the group ``unknown``; null and empty texts have no
token and belong to their cell like any other; cells without tokens are drawn with
probability 0; rows with the same id are drawn alike; a null id hashes as the empty text; an
empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import stored, whole

MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 8
BUDGET = 0.5  # expected share of all tokens
SEED = "mix"


def topic_of(text: Column) -> Column:
    """The form of a text stands for its topic: lists, links, figures or prose."""
    return (
        F.when(F.contains(text, F.lit("|")), "lists").when(F.contains(text, F.lit("http")), "links")
        .when(text.rlike("[0-9]"), "figures").otherwise("prose")
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_cell(docs: DataFrame) -> DataFrame:
    """The cell of each document as ``_source``, ``_lang`` and ``_topic``."""
    text = F.col("text").cast("string")
    return docs.select(
        "*", F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("_lang"), topic_of(text).alias("_topic"),
    )


def raked_cells(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, weight): weights sum to 1 and follow the targets."""
    cells = (
        with_cell(docs.select("text", "source", "lang")).groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS])
        .agg(F.sum(token_count(F.col("text").cast("string"))).alias("tokens")).where("tokens > 0")
    )
    cells = stored(cells, "cells")
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        share = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers[m])).alias("t"))
        total = share.agg(F.sum("t").alias("all")).first()["all"]
        if total is None:
            return out
        out = out.join(share.select(m, (F.col("t") / F.lit(total)).alias(f"target_{m}")), m)
    for _ in range(rounds):
        for m in MARGINS:
            sums = out.groupBy(m).agg(F.sum("weight").alias("sum"))
            out = out.join(sums, m).withColumn("weight", F.col("weight") * F.col(f"target_{m}") / F.col("sum")).drop("sum")
        out = stored(out, "raked")
    return out.select(*MARGINS, "tokens", "weight")


def drawing_rates(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, rate): rates give ``budget`` of all tokens in expectation.

    ``c`` is raised until no further cell reaches rate 1; each step reads a few sums.
    """
    ratio = F.col("weight") / F.col("tokens")
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"]
    if total is None:
        return cells.select(*MARGINS, F.lit(0.0).alias("rate"))
    c, full = 0.0, -1
    while True:
        held = ratio * F.lit(c) >= 1
        row = cells.agg(F.count_if(held).alias("k"), F.coalesce(F.sum(F.when(held, F.col("tokens"))), F.lit(0)).alias("t"), F.sum(F.when(~held, F.col("weight"))).alias("w")).first()
        if row.k == full or row.w is None:
            break
        full = row.k
        c = max(c, (budget * total - row.t) / row.w)
    return cells.select(*MARGINS, F.least(F.lit(1.0), ratio * F.lit(c)).alias("rate"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the id's digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_rates(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``_source``, ``_lang``, ``_topic`` and ``_rate``, names that it may not hold itself."""
    rates = drawing_rates(raked_cells(docs, powers, rounds), budget)
    rates = rates.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.col("rate").alias("_rate"))
    joined = with_cell(docs).join(rates, [f"_{m}" for m in MARGINS], "left")
    return joined.withColumn("_rate", F.coalesce("_rate", F.lit(0.0)))


def mix_sources(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The drawn documents, with the columns of ``docs``."""
    rows = with_rates(docs.select(whole(docs), "doc_id", "text", "source", "lang"), budget)
    return rows.where(uniform(F.col("doc_id")) < F.col("_rate")).select("row.*")


def mix_report(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cell, tokens, probability and the draw, for every document."""
    rows = with_rates(docs.select("doc_id", "text", "source", "lang"), budget)
    return rows.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        token_count(F.col("text").cast("string")).alias("n_tokens"), F.round("_rate", 6).alias("rate"),
        (uniform(F.col("doc_id")) < F.col("_rate")).alias("selected"),
    )


def rates_sql(documents: str = "documents") -> str:
    """DuckDB CTEs up to ``rated``: the documents with cell, tokens, rate and draw."""
    steps = [f"""celled AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE WHEN contains(text, '|') THEN 'lists' WHEN contains(text, 'http') THEN 'links'
              WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM {documents}
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM celled GROUP BY ALL HAVING sum(n_tokens) > 0
), w0 AS (
  SELECT *, tokens AS weight FROM cells
)"""]
    for m, power in (("source", 0.5), ("lang", 0.7), ("topic", 0.8)):
        steps.append(f"t_{m} AS (SELECT {m}, t / sum(t) OVER () AS target FROM (SELECT {m}, pow(sum(tokens), {power}) AS t FROM cells GROUP BY {m}))")
    n = 0
    for _ in range(8):
        for m in ("source", "lang", "topic"):
            n += 1
            steps.append(f"w{n} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, weight * target / sum(weight) OVER (PARTITION BY w.{m}) AS weight FROM w{n - 1} w JOIN t_{m} t ON t.{m} = w.{m})")
    steps.append(f"""ordered AS (
  SELECT *, weight / tokens AS ratio,
         coalesce(sum(tokens) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(weight) OVER (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below,
         sum(tokens) OVER () AS everything
  FROM w{n}
), solved AS (
  SELECT max((0.5 * everything - above) / below) FILTER (WHERE ratio * (0.5 * everything - above) / below <= 1) AS c FROM ordered
), rated AS (
  SELECT d.*, coalesce(least(1.0, ratio * c), 0.0) AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM celled d LEFT JOIN (SELECT * FROM ordered, solved) r ON r.source = d.source AND r.lang = d.lang AND r.topic = d.topic
)""")
    return "WITH " + ",\n".join(steps)


ORACLE = rates_sql() + """
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate, u < rate AS selected FROM rated
"""
