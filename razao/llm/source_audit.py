"""How far the sources of a language differ in their terms.

Each task lays texts side by side in one Arrow buffer and keeps a pointer to the start of every
term. The pointers are sorted by the bytes they point to with a multikey quicksort that takes
eight bytes as one character: pointers are sorted by the character at the present depth, and only
runs of equal characters that are not at their end go on to the next depth. Equal runs of the
sorted pointers give a term's occurrences and documents in each (language, source), which Spark
then adds up by term over all tasks.

Kept terms of a language occur in ``min_docs`` of its documents. Shares are integers, smoothed and
floored, and all sums are exact. Sources are compared in blocks: a group holds a slice of the
kept terms and two blocks of sources, and only terms with a count there; terms that neither
source has are added as a product. So no pair of rows is built, and neither a large language nor
a hot source has to fit in one task.

Defined results: null text, language and source are empty; every row is a document, repeated rows
and ids as well; terms end at any ASCII character that is no letter, all other characters belong
to terms; a language without kept terms has pairs with value 0 and no terms; a language with one
source has no pairs; ties go by the item's UTF-8 bytes; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from razao.llm.common import Texts, run_starts, stored, text_chunks

MIN_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS = 3  # a share is floored at 1000 ** 3
TERMS_A_SLICE = 512
SOURCES_A_BLOCK = 128
CHARACTER = 8
CHUNK = 2 << 20
# mask of the first k of eight bytes, k = 0 to 8
LEADING = np.array([0, *(0xFFFFFFFFFFFFFFFF << 8 * k & 0xFFFFFFFFFFFFFFFF for k in range(CHARACTER - 1, -1, -1))], np.uint64)
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True


def term_pointers(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every term in the buffer."""
    inside = np.concatenate([[False], IN_TERM[t.bytes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    return starts, edges[1::2] - starts, t.owner(starts)


def characters(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``depth`` of each pointer, the first one highest, zeros past the end.

    ``buffer`` has eight spare bytes at its end. No term holds a zero byte.
    """
    at_every_byte = np.ndarray(len(buffer) - CHARACTER + 1, ">u8", buffer, strides=(1,))
    left = np.clip(lengths - depth, 0, CHARACTER)
    return at_every_byte[starts + np.minimum(depth, lengths)].astype(np.uint64) & LEADING[left]


def sort_pointers(t: Texts, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pointers' order by term, and at each place of that order whether a new term begins."""
    n = len(starts)
    order, fresh = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, fresh
    buffer = np.concatenate([t.bytes, np.zeros(CHARACTER, np.uint8)])
    fresh[0] = True
    active, depth = np.arange(n), 0  # places of the order that are still tied
    while len(active):
        pointers = order[active]
        keys = characters(buffer, starts[pointers], lengths[pointers], depth)
        group = np.cumsum(fresh[active])
        by = np.argsort(keys) if depth == 0 else np.lexsort((keys, group))
        order[active] = pointers[by]
        keys, group = keys[by], group[by]
        differs = np.concatenate([[True], (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])])
        fresh[active] |= differs
        depth += CHARACTER
        # runs of one pointer are done, and so are runs whose terms have ended
        run = np.flatnonzero(differs)
        sizes = np.diff(np.append(run, len(active)))
        open_run = (sizes > 1) & (keys[run] & np.uint64(0xFF) != 0)
        active = active[np.repeat(open_run, sizes)]
    return order, fresh


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_chunks(batches, limit=CHUNK):
            t = Texts(texts, fold=True)
            starts, lengths, owner = term_pointers(t)
            order, fresh = sort_pointers(t, starts, lengths)
            groups, lang, source = _groups(batch)
            # rows in the order of their group, so that a term's runs by group hold runs by document
            rank = np.empty(t.n, np.int64)
            rank[np.argsort(groups, kind="stable")] = np.arange(t.n)
            key = np.sort((np.cumsum(fresh) - 1) * t.n + rank[owner[order]])
            new_doc = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            term, own = key // max(1, t.n), np.sort(groups)[key % max(1, t.n)]
            cell = run_starts(term * (len(lang) + 1) + own)
            ends = np.append(cell[1:], len(key))[: len(cell)]
            seen = np.concatenate([[0], np.cumsum(new_doc)])
            words = _strings(t.bytes, starts[order[fresh]], lengths[order[fresh]])
            own = pa.array(own[cell])
            yield pa.RecordBatch.from_arrays(
                [lang.take(own), source.take(own), words.take(pa.array(term[cell])), pa.array(ends - cell, pa.int64()), pa.array(seen[ends] - seen[cell], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _strings(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes that the pointers point to, as an Arrow array."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = buffer[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """A number for each row's (lang, source), and both values by number."""
    pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
    number = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
    codes = np.fromiter((number[pair] for pair in pairs), np.int64, len(pairs))
    return codes, pa.array([lang for lang, _ in number], pa.string()), pa.array([source for _, source in number], pa.string())


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), three digits at a time.

    Exact while the divisor is below 9 * 10 ** 15; ``count + 2`` never exceeds it.
    """
    below = total + 2 * terms
    rest, out = (count + 2).cast("long"), F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, below)
        rest = rest % below
    return out + 1


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same in numpy."""
    below = totals + 2 * terms
    rest, out = counts + 2, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n) of the terms that a language keeps."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    return counts.select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"])


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) of the documents: its total, its language's total and kept terms,
    its number among the sources of the language and their count."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    in_lang = Window.partitionBy("lang")
    out = groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    return out.withColumns({"number": F.row_number().over(in_lang.orderBy("source")) - 1, "sources": F.count("*").over(in_lang)})


def pair_values(kept: DataFrame, totals: DataFrame, terms_a_slice: int = TERMS_A_SLICE, sources_a_block: int = SOURCES_A_BLOCK) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    placed = totals.select(
        "lang", "source", "total", "terms", "number", F.floor(F.col("number") / sources_a_block).cast("int").alias("block"),
        F.ceil(F.col("sources") / sources_a_block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("terms") / terms_a_slice).cast("int")).alias("slices"),
    )
    columns = ["lang", "slice", "block", "blocks", "source", "number", "total", "terms", "term", "n"]
    rows = kept.select("lang", "source", "term", "n").join(placed, ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).select(*columns)
    # a source is present in every slice, with or without a term there
    heads = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}).select(*columns)
    dealt = rows.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    parts = dealt.groupBy("lang", "slice", "low", "high").applyInPandas(_block_values, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _block_values(pdf: pd.DataFrame) -> pd.DataFrame:
    """Divergence of all pairs of two blocks of sources over the terms of a slice."""
    heads = pdf[pdf["term"].isna()].sort_values("number")
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    terms, first = int(pdf["terms"].iloc[0]), int(pdf["slice"].iloc[0]) == 0
    filled = pdf[pdf["term"].notna()]
    code, words = pd.factorize(filled["term"])
    counts = np.zeros((len(words), len(heads)), np.int64)
    counts[code, np.searchsorted(heads["number"].to_numpy(), filled["number"].to_numpy())] = filled["n"].to_numpy()
    names, block, total = heads["source"].to_numpy(), heads["block"].to_numpy(), heads["total"].to_numpy()
    sides = np.flatnonzero(block == low), np.flatnonzero(block == high)
    values = np.zeros((len(sides[0]), len(sides[1])), np.int64)
    if terms:
        p, absent = shares(counts, total, terms), shares(np.zeros(len(heads), np.int64), total, terms)
        other, none = p[:, sides[1]], absent[sides[1]]
        for i, g in enumerate(sides[0]):
            # terms that neither source has give the same value each; slice 0 adds them for all terms
            without = _divergence(absent[g], none)
            values[i] = _divergence(p[:, g, None], other).sum(axis=0) + without * ((terms if first else 0) - len(words))
    a, b = (x.ravel() for x in np.meshgrid(sides[0], sides[1], indexing="ij"))
    v, apart = values.ravel(), a != b
    a, b, v = a[apart], b[apart], v[apart]
    if low != high:
        a, b, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
    return pd.DataFrame({"lang": np.full(len(v), pdf["lang"].iloc[0], object), "source": names[a], "item": names[b], "value": v})


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def term_values(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    joined = kept.join(totals, ["lang", "source"])
    joined = joined.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    gap = F.col("p") - F.col("q")
    return joined.where("p > q").select("lang", "source", "item", F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of all pairs and of the leading terms."""
    kept = stored(kept_counts(stored(term_counts(docs), "terms"), min_docs), "kept-terms")
    totals = stored(group_totals(docs, kept), "term-totals")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(kept, totals).withColumn("rank", F.row_number().over(ranked))
    terms = term_values(kept, totals).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM rows
), tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM rows
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM kept GROUP BY lang
), counted AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM tokens t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL
), shared AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(o.total, 0) + 2 * l.terms) AS p,
         1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.terms) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals o ON o.lang = g.lang AND o.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shared a JOIN shared b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), items AS (
  SELECT * FROM every_pair
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shared WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM items QUALIFY part = 'pair' OR rank <= 10
"""
