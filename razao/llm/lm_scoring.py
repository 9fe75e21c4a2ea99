"""Code lengths of texts under context-tree weighting.

A text is read as its words, each with a space after it, and one line feed as the end. Every byte
is eight binary decisions, each with a context tree over the DEPTH bytes before it, which run on
across spaces into the preceding words; before a text's first word stand one space and nothing.
A node has counts of zeros and ones; its
Krichevsky-Trofimov estimate is mixed with what its deeper contexts say, with the weight
one half to either at every depth. Weights come from one upward pass over the counted nodes, the
prediction of a byte from one downward pass. A context that training never met hands its weight
to the longest one that it did meet, so that every prediction is a distribution.

Scale: distinct (context, byte) pairs are counted from the texts with sums inside each task and
split by their last two context bytes, so that whole subtrees lie in one task; what is
above has at most 65,280 nodes. Codes are looked up for the most frequent pairs in
arrays of bounded size and joined for all others; the counts of words for the base score, too.

Defined results: null and empty texts are the end token alone; a null doc_id counts as the
empty text when the parts are drawn; repeated rows count and are scored each; without a training
document every bit has probability one half; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.llm.common import WHITE, Texts, bucket_of, run_starts, signed, stored, text_chunks

DEPTH = 6
CACHED_PAIRS = 1 << 21
CACHED_WORDS = 1 << 18
MERGE_ROWS = 800_000
MERGE_PAIRS = 1 << 21
SLICE_PAIRS = 1 << 15
END = 0x20 << 8 | 0x0A  # the line feed in the context of a token's start


# ---------------------------------------------------------------- counting


def _merge(h: list, n: list, words: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    keys, first, inverse = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate(n), minlength=len(keys))
    return keys, total, pa.concat_arrays(words).take(pa.array(first))


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, word, n) of all words; ``n`` counts those in training documents (``train``)."""

    def count(batches):
        h: list = []
        n: list = []
        words: list = []
        rows = 0
        for batch, texts in text_chunks(batches):
            t = Texts(texts, fold=True)
            starts, ends, owner = t.words()
            train = np.array(batch.column(1).to_pylist(), bool)
            keys, first, inverse = np.unique(t.hashes(starts, ends), return_index=True, return_inverse=True)
            raw = t.bytes.tobytes()
            h.append(keys)
            n.append(np.bincount(inverse, train[owner].astype(float), minlength=len(keys)))
            words.append(pa.array([raw[a:b] for a, b in zip(starts[first], ends[first], strict=True)], pa.binary()))
            rows += len(keys)
            if rows > MERGE_ROWS:
                keys, total, kept = _merge(h, n, words)
                if len(keys) > MERGE_ROWS // 2:
                    yield from _word_rows(keys, total, kept)
                    h, n, words, rows = [], [], [], 0
                else:
                    h, n, words, rows = [keys], [total], [kept], len(keys)
        if h:
            yield from _word_rows(*_merge(h, n, words))

    rows = docs.select(F.col("text").cast("string").alias("text"), "train")
    return rows.mapInArrow(count, "hash long, word binary, n long").groupBy("hash", "word").agg(F.sum("n").alias("n"))


def _word_rows(keys, total, words, step: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), step):
        part = slice(at, at + step)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[part])), words[part], pa.array(total[part].astype(np.int64))], names=["hash", "word", "n"])


def token_stream(t: Texts, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each text): the words with a space after each, then the end, if wanted."""
    _, after, _ = t.words()
    last = t.starts + t.sizes
    copies = (~WHITE[t.bytes]).astype(np.int64)
    copies[after] += 1
    copies[last] += ends
    upto = np.cumsum(copies)
    before = upto - copies
    out = np.repeat(t.bytes, copies)
    out[before[after]] = 0x20
    if ends:
        out[upto[last] - 1] = 0x0A
    return out, upto[last] - before[t.starts]


def pairs_of(t: Texts, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, pair) for every byte of the token streams; a pair is context and byte."""
    raw, sizes = token_stream(t, ends)
    who = np.repeat(np.arange(t.n), sizes)
    padded = np.concatenate([np.zeros(DEPTH, np.uint8), raw])
    key = raw.astype(np.int64)
    for d in range(1, DEPTH + 1):
        key |= padded[DEPTH - d : len(padded) - d].astype(np.int64) << (8 * d)
    # nothing of the text before: a space, then zeros
    first = np.cumsum(sizes) - sizes
    for place in range(DEPTH):
        at = first[sizes > place] + place
        key[at] = key[at] & ((1 << 8 * (place + 1)) - 1) | 0x20 << 8 * (place + 1)
    return who, key


def pair_counts(texts: DataFrame, documents: int | None = None) -> DataFrame:
    """(pair, n): distinct contexts with their next byte, also those of training count 0.

    ``texts`` has the text as ``word`` and how often it counts as ``n``. Every text has its end,
    unless a number of ``documents`` is given: then the texts are parts, and so many ends stand
    alone.
    """
    ends = documents is None

    def merged(keys, n):
        # sorted runs, which a stable sort merges
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = run_starts(key)
        return key[starts], np.add.reduceat(np.concatenate(n)[order], starts) if len(starts) else np.zeros(0, np.int64)

    def count(batches):
        keys, n, rows = [], [], 0
        for batch, found in text_chunks(batches, "word"):
            who, key = pairs_of(Texts(found, fold=True), ends)
            own = np.asarray(batch.column(1))[who]
            for times in np.unique(own):
                k, repeats = np.unique(key[own == times], return_counts=True)
                keys.append(k)
                n.append(repeats * times)
                rows += len(k)
            if rows > MERGE_PAIRS:
                k, total = merged(keys, n)
                keys, n, rows = [k], [total], len(k)
                if rows > MERGE_PAIRS * 3 // 4:
                    yield from _pair_rows(k, total)
                    keys, n, rows = [], [], 0
        if keys:
            yield from _pair_rows(*merged(keys, n))

    counted = texts.select("word", F.col("n").cast("long").alias("n")).mapInArrow(count, "pair long, n long")
    if not ends:
        counted = counted.union(texts.sparkSession.createDataFrame([(END, documents)], "pair long, n long"))
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _pair_rows(keys: np.ndarray, total: np.ndarray, step: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), step):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + step]), pa.array(total[at : at + step])], names=["pair", "n"])


# ---------------------------------------------------------------- the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series after eight steps of the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def mixed(kt: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, deeper) - np.log(2)


class Subtree:
    """Nodes of depth ``top`` to DEPTH above a set of pairs, all pairs of their subtrees given."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, top: int = 2):
        steps = np.arange(8)
        byte = pairs & 255
        self.bit = (byte[:, None] >> (7 - steps)[None, :] & 1).ravel()
        part = ((1 << steps)[None, :] | byte[:, None] >> (8 - steps)[None, :]).ravel()
        context = np.repeat(pairs >> 8, 8)
        weight = np.repeat(n.astype(float), 8)
        self.top, self.at, self.keys = top, {}, {}
        self.zeros, self.ones, self.kt, self.pw = {}, {}, {}, {}
        parent = None
        for d in range(DEPTH, top - 1, -1):
            key = (context & ((1 << 8 * d) - 1)) << 8 | part
            self.keys[d], first, at = np.unique(key, return_index=True, return_inverse=True)
            self.at[d] = at
            m = len(self.keys[d])
            self.ones[d] = np.bincount(at, weight * self.bit, minlength=m)
            self.zeros[d] = np.bincount(at, weight * (1 - self.bit), minlength=m)
            self.kt[d] = log_kt(self.zeros[d], self.ones[d])
            if parent is None:
                self.pw[d] = self.kt[d]
            else:
                # one entry per deeper node, at its first pair
                self.pw[d] = mixed(self.kt[d], np.bincount(at[parent], self.pw[d + 1], minlength=m))
            parent = first

    def code(self, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]], pairs: np.ndarray) -> np.ndarray:
        """log10 of each pair's predicted probability; ``upper`` has the nodes above ``top``."""
        steps = np.arange(8)
        byte = pairs & 255
        part = ((1 << steps)[None, :] | byte[:, None] >> (8 - steps)[None, :]).ravel()
        context = np.repeat(pairs >> 8, 8)
        levels = []
        for d, (zeros, ones, stop) in enumerate(upper):
            key = (context & ((1 << 8 * d) - 1)) << 8 | part
            levels.append((zeros[key], ones[key], stop[key]))
        for d in range(self.top, DEPTH + 1):
            stop = np.exp(self.kt[d] - np.log(2) - self.pw[d]) if d < DEPTH else np.ones(len(self.kt[d]))
            at = self.at[d]
            levels.append((self.zeros[d][at], self.ones[d][at], stop[at]))
        p, left = np.zeros(len(part)), np.ones(len(part))
        for d, (zeros, ones, stop) in enumerate(levels):
            own = (np.where(self.bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            if d + 1 < len(levels):
                met = levels[d + 1][0] + levels[d + 1][1] > 0
                stop = np.where(met, stop, 1.0)
            p += left * stop * own
            left = left * (1 - stop)
        return np.log10(np.maximum(p, 1e-300)).reshape(-1, 8).sum(1)


def _slices(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A partition's pairs in slices that keep the pairs of two last context bytes together."""
    rows = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if len(b.column(0))]
    if not rows:
        return
    key, n = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    last = key >> 8 & 0xFFFF
    order = np.argsort(last, kind="stable")
    key, n, last = key[order], n[order], last[order]
    groups = np.concatenate([np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])), [len(key)]])
    start = 0
    for a, b in zip(groups[:-1], groups[1:], strict=True):
        if b - start > SLICE_PAIRS and a > start:
            yield key[start:a], n[start:a]
            start = a
    yield key[start:], n[start:]


def pair_codes(pairs: DataFrame) -> DataFrame:
    """(pair, n, code): log10 of each pair's probability.

    Upward: subtrees below the last two context bytes in tasks, then below the last byte, whose
    at most 65,280 nodes close on the driver. Downward in the same tasks.
    """
    dealt = pairs.repartition(F.pmod(F.shiftright("pair", 8), F.lit(65536)))

    def upward(batches):
        for key, n in _slices(batches):
            t = Subtree(key, n)
            yield pa.RecordBatch.from_arrays([pa.array(t.keys[2]), pa.array(t.zeros[2]), pa.array(t.ones[2]), pa.array(t.pw[2])], names=["node", "zeros", "ones", "pw"])

    schema = "node long, zeros double, ones double, pw double"
    second = dealt.mapInArrow(upward, schema)
    # sums of the children of every node of depth 1: at most 256 * 255 rows
    first = F.pmod(F.shiftright("node", 8), F.lit(256)) * 256 + F.pmod("node", F.lit(256))
    rows = second.groupBy(first.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw")).toArrow()
    size = 256 * 256
    zeros, ones, deeper = (np.zeros(size) for _ in range(3))
    at = rows["node"].to_numpy()
    zeros[at], ones[at], deeper[at] = (rows[c].to_numpy() for c in ("zeros", "ones", "pw"))
    kt = log_kt(zeros, ones)
    pw = mixed(kt, deeper)
    one = (zeros, ones, np.exp(kt - np.log(2) - pw))
    zeros0, ones0, deeper0 = (x.reshape(256, 256).sum(0) for x in (zeros, ones, pw))
    kt0 = log_kt(zeros0, ones0)
    upper = [(zeros0, ones0, np.exp(kt0 - np.log(2) - mixed(kt0, deeper0))), one]

    def downward(batches):
        for key, n in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(Subtree(key, n).code(upper, key))], names=["pair", "n", "code"])

    return dealt.mapInArrow(downward, "pair long, n long, code double")


# ---------------------------------------------------------------- scoring


def most_frequent(df: DataFrame, limit: int) -> DataFrame:
    """The rows with the largest ``n``, whole powers of two of it, at most ``limit`` of them."""
    steps = df.groupBy(F.floor(F.log2(F.col("n") + 1)).cast("int").alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:
        total += row.k
        if total > limit:
            break
        least = row.step
    return df.where(F.floor(F.log2(F.col("n") + 1)) >= least) if least is not None else df.where(F.lit(False))


def _sorted_arrays(df: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    got = df.select(key, *values).toArrow()
    columns = [got.column(c).to_numpy() for c in (key, *values)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in sorted ``keys`` and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _listed(who: np.ndarray, what: np.ndarray, names: np.ndarray, n: int) -> list[pa.ListArray]:
    """For each of ``n`` texts the distinct names it holds, and how often."""
    pair, repeats = np.unique(who * len(names) + what, return_counts=True)
    who, what = (pair // len(names), pair % len(names)) if len(names) else (pair, pair)
    upto = pa.array(np.searchsorted(who, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(upto, pa.array(v)) for v in (names[what], repeats.astype(np.int64))]


def code_sums(t: Texts, ends: bool, keys: np.ndarray, values: np.ndarray) -> tuple:
    """(sum of the codes at hand, the other pairs, how often) for each text."""
    who, key = pairs_of(t, ends)
    pair, inverse = np.unique(key, return_inverse=True)
    at, found = _find(keys, pair)
    code = np.where(found, values[at], 0.0) if len(keys) else np.zeros(len(pair))
    rest = np.flatnonzero(~found[inverse])
    return np.bincount(who, code[inverse], minlength=t.n).astype(float), *_listed(who[rest], inverse[rest], pair, t.n)


def other_codes(summed: DataFrame, row: str, codes: DataFrame) -> DataFrame:
    """(row, code2): the codes of the pairs that were not at hand, summed by ``row``."""
    rest = summed.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(row, F.col("p.pairs").alias("pair"), F.col("p.times").alias("k"))
    return rest.join(codes.select("pair", F.col("code").alias("c")), "pair").groupBy(row).agg(F.sum(F.col("k") * F.col("c")).alias("code2"))


def word_codes(vocabulary: DataFrame, codes: DataFrame, cached: int = CACHED_PAIRS) -> DataFrame:
    """(hash, n, code): log10 probability of every word with the space after it, as a text's first."""
    held = vocabulary.sparkSession.sparkContext.broadcast(_sorted_arrays(most_frequent(codes, cached), "pair", "code"))

    def add(batches):
        for batch, words in text_chunks(batches, "word"):
            sums, pairs, times = code_sums(Texts(words, fold=True), False, *held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums), pairs, times], names=["hash", "n", "code", "pairs", "times"])

    summed = stored(vocabulary.select("hash", "word", "n").mapInArrow(add, "hash long, n long, code double, pairs array<long>, times array<long>"), "words")
    out = summed.join(other_codes(summed, "hash", codes), "hash", "left")
    return out.select("hash", "n", (F.col("code") + F.coalesce("code2", F.lit(0.0))).alias("code"))


def score(docs: DataFrame, words: DataFrame, codes: DataFrame, total: int, distinct: int, end_count: int, cached: int = CACHED_WORDS, cached_pairs: int = CACHED_PAIRS) -> DataFrame:
    """Sums over each document's tokens of the base and the model's logarithms."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((_sorted_arrays(most_frequent(words, cached), "hash", "n"), _sorted_arrays(most_frequent(codes, cached_pairs), "pair", "code")))
    denominator = np.log10(total + distinct + 1.0)
    end_base = np.log10(end_count + 1.0) - denominator

    def add(batches):
        (hashes, counts), at_hand = held.value
        for batch, texts in text_chunks(batches):
            t = Texts(texts, fold=True)
            starts, ends, owner = t.words()
            key, inverse = np.unique(signed(t.hashes(starts, ends)), return_inverse=True)
            at, found = _find(hashes, key)
            c = np.where(found, counts[at], 0) if len(hashes) else np.zeros(len(key))
            base = np.where(found, np.log10(c + 1.0) - denominator, 0.0)
            n = len(texts)
            tokens = np.bincount(owner, minlength=n) + 1
            known = np.bincount(owner, (c > 0)[inverse], minlength=n).astype(np.int64) + (end_count > 0)
            size = t.sizes + 0
            # the others: one row per document and distinct word or pair
            other = np.flatnonzero(~found[inverse])
            code, pairs, times = code_sums(t, True, *at_hand)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(size), pa.array(np.bincount(owner, base[inverse], minlength=n) + end_base), pa.array(code), *_listed(owner[other], inverse[other], key, n), pairs, times],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "code", "words", "repeats", "pairs", "times"],
            )

    rows = docs.select(F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (~F.col("train")).alias("held_out"))
    part = stored(rows.mapInArrow(add, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, code double, words array<long>, repeats array<long>, pairs array<long>, times array<long>"), "parts")
    rest = part.select("row", F.explode(F.arrays_zip("words", "repeats")).alias("w")).select("row", F.col("w.words").alias("hash"), F.col("w.repeats").alias("k"))
    base = F.log10(F.col("n") + 1.0) - F.lit(float(denominator))
    rest = rest.join(words.select("hash", "n"), "hash").groupBy("row").agg(F.sum(F.col("k") * base).alias("base2"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known2"))
    out = part.drop("words", "repeats", "pairs", "times").join(rest, "row", "left").join(other_codes(part, "row", codes), "row", "left")
    model = F.col("code") + F.coalesce("code2", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), model.alias("score"), (-model / F.lit(float(np.log10(2))) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on the ids whose crc32 modulo 7 is not 2, score every document."""
    docs = docs.select("doc_id", "text", (bucket_of(F.col("doc_id"), 7) != 2).alias("train"))
    vocabulary = stored(word_counts(docs), "vocabulary")
    documents = docs.where("train").count()
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = sums.n + documents, sums.v + (documents > 0)
    texts = docs.select(F.col("text").cast("string").alias("word"), F.col("train").cast("long").alias("n"))
    codes = stored(pair_codes(stored(pair_counts(texts), "pairs")), "codes")
    return score(docs, vocabulary, codes, total, distinct, documents)
