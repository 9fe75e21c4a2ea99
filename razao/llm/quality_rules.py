"""Learned decision lists over text statistics.

``text_statistics`` measures every whole text. ``learn_rules`` grows and prunes conjunctions of
thresholds on labelled statistics by sequential covering. ``rules_column`` turns the ordered
list into one conditional expression that Spark evaluates for all rows.

Defined results: a null text counts as empty (no words, base check failed); a null label takes
no part in learning; when a document is labelled more than once, its lowest label counts;
documents with the same id are judged row by row; an empty label table gives an empty list,
which keeps everything the base check passes. Input columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import WHITE, Texts, mix, run_starts, text_chunks

MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_upper", "n_digits", "n_chars")
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "words_per_line", "mark_rate", "upper_rate", "digit_rate")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
MARK = np.zeros(256, np.int64)
MARK[list(b"!?=+~^@_/\\{}[]")] = 1
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
DIGIT = np.zeros(256, np.int64)
DIGIT[48:58] = 1
LEAD = np.ones(256, np.int64)  # bytes that begin a code point
LEAD[128:192] = 0
LEAD_IN_WORD = LEAD * ~WHITE


def _measure(texts: list[bytes]) -> list[np.ndarray]:
    t = Texts(texts)
    starts, ends, owner = t.words()
    word = t.hashes(starts, ends)
    n_words = np.bincount(owner, minlength=t.n)
    own = mix(owner.astype(np.uint64) + np.uint64(1))
    tagged = np.sort(word ^ own)
    # distinct words, by owner of the first of each run
    order = np.argsort(word ^ own, kind="stable")
    distinct = np.bincount(owner[order[run_starts(tagged)]], minlength=t.n)
    # words in windows of three found twice or more in the text
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        w = word * np.uint64(3)
        window = mix(w[:-2] + mix(w[1:-1] + mix(w[2:]))) ^ own[:-2]
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        by = inside[np.argsort(window[inside], kind="stable")]
        first = run_starts(window[by])
        sizes = np.diff(np.concatenate([first, [len(by)]])).astype(np.int64)
        again = by[np.repeat(sizes > 1, sizes)]
        for k in range(3):
            covered[again + k] = True
    repeated = np.bincount(owner[covered], minlength=t.n)
    # lines that hold a word and equal an earlier line of the text
    l_starts, l_ends, l_owner = t.lines()
    solid = np.concatenate([[0], np.cumsum(~WHITE[t.bytes])])
    filled = np.flatnonzero(solid[l_ends] > solid[l_starts])
    key = t.hashes(l_starts[filled], l_ends[filled]) ^ mix(l_owner[filled].astype(np.uint64) + np.uint64(1))
    line_order = np.argsort(key, kind="stable")
    fresh = np.zeros(len(filled), bool)
    fresh[line_order[run_starts(key[line_order])]] = True
    dups = np.bincount(l_owner[filled[~fresh]], minlength=t.n)
    lines = np.bincount(l_owner[filled], minlength=t.n)
    return [n_words, t.counts(LEAD_IN_WORD), t.counts(SYMBOL), dups, repeated, lines, distinct, t.counts(MARK), t.counts(UPPER), t.counts(DIGIT), t.counts(LEAD)]


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document, over its whole text."""

    def measure(batches):
        for batch, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in _measure(texts)]], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, SCHEMA)


def with_features(stats: DataFrame) -> DataFrame:
    def rate(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return stats.select(
        "*", rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_distinct", "n_words").alias("distinct_rate"), rate("n_words", "n_lines").alias("words_per_line"),
        rate("n_marks", "n_words").alias("mark_rate"), rate("n_upper", "n_chars").alias("upper_rate"),
        rate("n_digits", "n_chars").alias("digit_rate"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) that calls a document bad."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def mask(self, x: np.ndarray, names=FEATURES) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, side, cut in self.conditions:
            v = x[:, names.index(name)]
            out &= v <= cut if side == "<=" else v > cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, side, cut in self.conditions:
            out = out & ((F.col(name) <= F.lit(cut)) if side == "<=" else (F.col(name) > F.lit(cut)))
        return out


def _best_condition(x, bad, inside, steps=64):
    """The condition with the most gain in FOIL's sense over the rows inside."""
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    best = (1e-9, None)
    base = np.log2(p0 / (p0 + n0))
    for j, name in enumerate(FEATURES):
        v = x[:, j]
        values = np.unique(v[inside])
        if len(values) < 2:
            continue
        cuts = (values[:-1] + values[1:]) / 2
        if len(cuts) > steps:
            cuts = np.unique(np.concatenate([np.quantile(v[inside & bad], np.linspace(0, 1, steps // 2)), cuts[np.linspace(0, len(cuts) - 1, steps // 2).astype(int)]]))
        for cut in cuts:
            low = inside & (v <= cut)
            p, n = int((low & bad).sum()), int((low & ~bad).sum())
            for side, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if a and a + b < p0 + n0:
                    gain = a * (np.log2(a / (a + b)) - base)
                    if gain > best[0]:
                        best = (gain, (name, side, float(cut)))
    return best[1]


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 7, min_cover: int = 3, min_precision: float = 0.9, max_rules: int = 24) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, remove what is covered."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad).sum() >= min_cover:
        grow = left & (rng.random(len(x)) < 2 / 3)
        prune = left & ~grow
        conditions: list = []
        inside = grow.copy()
        while (inside & bad).any() and (inside & ~bad).any() and len(conditions) < 5:
            found = _best_condition(x, bad, inside)
            if found is None:
                break
            conditions.append(found)
            inside &= Rule((found,), 0).mask(x)
        if not conditions:
            break

        def worth(conds, prune=prune):
            m = Rule(tuple(conds), 0).mask(x) & prune
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        covered = Rule(tuple(conditions), 0).mask(x) & left
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if p < min_cover or (p + 1) / (p + n + 2) < min_precision:
            break
        rules.append(Rule(tuple(conditions), round(p / (p + n), 6)))
        left &= ~covered
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled documents, chosen by a hash of the id."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = with_features(text_statistics(texts)).join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", *FEATURES).toArrow()
    if not rows.num_rows:
        return []
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", *FEATURES)])
    x = np.column_stack([rows.column(c).to_numpy().astype(float) for c in FEATURES])
    return learn_rules(x, rows.column("_label").to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Counts, base check, first rule that holds, and the verdict, for every document."""
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    measured = with_features(text_statistics(docs)).select("*", failed.alias("base_failed"), rules_column(rules).alias("rule"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), F.col("rule").cast("int").alias("rule"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Learn the list from ``labels`` (doc_id, quality) and judge every document."""
    return judge(docs, fit(docs, labels, max_labelled=max_labelled))
