"""Exact Jaccard join on word n-grams, with skipping by set relations.

1. Equal sets are one class. A fixed-size count sketch over all n-grams gives one global order,
   rare first, and each class indexes the prefix that any partner must share with it.
2. Index lists are read by position: within a list, the class with the smallest position is the
   most complete relative of the others. Its answers are computed first, one verification per
   member, and whole stretches that are too far back in a list are skipped.
3. The members' own answers are derived from those of their relative: two members that answered
   the same one are connected already. Only pairs of different components remain, and of these
   only pairs that pass the size, position and difference bounds are verified.
4. Verified links are closed to components.

Difference bound: every class has a parity bitmap (a bit flips for each n-gram hashed to it); the
bits in which two bitmaps differ are a lower bound for the number of n-grams in which the sets
differ.

Defined results: null and empty texts and texts without a word have an empty set and link with
nothing; a text with fewer words than n has one n-gram, all its words; rows are compared by
their text, so rows that repeat a doc_id each count; a null doc_id never names a component; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import Texts, components, mix, run_starts, signed, stored, summed_vector, text_chunks, whole

WORDS = 3
PERCENT = 90
SKETCH_BITS = 20
FILTER_BITS = 20


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every text's distinct n-grams, sorted."""
    t = Texts(texts, fold=True)
    starts, ends, owner = t.words()
    w = t.hashes(starts, ends) * np.uint64(3)
    n = len(w)
    parts = []
    if n >= words:
        h = mix(w[words - 1 :])
        for k in range(words - 2, -1, -1):
            h = mix(w[k : n - words + 1 + k] + h)
        whole = owner[: n - words + 1] == owner[words - 1 :]
        parts.append((owner[: n - words + 1][whole], h[whole]))
    per_text = np.bincount(owner, minlength=t.n)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]]).astype(np.int64) if t.n else np.zeros(0, np.int64)
    for size in range(1, words):
        few = np.flatnonzero(per_text == size)
        h = np.full(len(few), np.uint64(size))
        for k in range(size - 1, -1, -1):
            h = mix(w[first[few] + k] + h + np.uint64(words + k))
        parts.append((few, h))
    who = np.concatenate([p[0] for p in parts]).astype(np.int64)
    h = np.concatenate([p[1] for p in parts]).astype(np.uint64)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    if len(h):
        keep = np.concatenate([[True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])])
        who, h = who[keep], h[keep]
    return who, h


def class_ids(who: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number per set, from sums over its members."""
    out = np.zeros(n, np.uint64)
    if len(h):
        first = run_starts(who)
        a = np.add.reduceat(mix(h + np.uint64(1)), first)
        b = np.add.reduceat(mix(h + np.uint64(2)), first)
        out[who[first]] = mix(a + mix(b))
    return out


def parity_bits(h: np.ndarray) -> bytes:
    """The parity bitmap of one set, of a power of two bits, about half the set's size."""
    size = 1 << max(6, (len(h) - 1).bit_length() - 1)
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def difference_bound(a: bytes, b: bytes) -> int:
    """A lower bound for the size of the symmetric difference of two sets."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def least_shared(n1: Column, n2: Column, percent: int) -> Column:
    """The fewest common members two linked sets of these sizes have."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def gram_order(docs: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Frequency steps of all n-grams, by the leading bits of their hash; fixed in size."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for _, texts in text_chunks(batches):
            total += np.bincount((shingle_sets(texts, words)[1] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return total

    counts = summed_vector(_rows(docs).select("text"), count, 1 << bits)
    return np.minimum(255, np.floor(4 * np.log2(counts + 1.0))).astype(np.uint8)


def indexed_sets(docs: DataFrame, order: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, class, n, prefix, bits) per document; ``prefix`` holds the rarest n-grams."""
    shift = np.uint64(64 - int(len(order)).bit_length() + 1)

    def index(batches):
        for batch, texts in text_chunks(batches):
            who, h = shingle_sets(texts, words)
            ids = class_ids(who, h, len(texts))
            sizes = np.bincount(who, minlength=len(texts))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            rank = order[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
            prefix, bits = [], []
            for i, n in enumerate(sizes):
                own = h[starts[i] : starts[i + 1]]
                k = n - (percent * n + 99) // 100 + 1 if n else 0
                near = rank[starts[i] : starts[i + 1]]
                top = np.argpartition(near, k - 1)[:k] if 0 < k < n else np.arange(n)
                prefix.append(signed(own[top[np.argsort(near[top], kind="stable")]]))
                bits.append(parity_bits(own) if n else b"")
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(ids)), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())], names=["doc_id", "class", "n", "prefix", "bits"])

    return _rows(docs).mapInArrow(index, "doc_id long, class long, n long, prefix array<long>, bits binary")


def _close_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps do not rule them out."""
    own = classes.select("class", "n", "bits", "doc_id")
    both = pairs.join(own.select(F.col("class").alias("u"), F.col("n").alias("n1"), F.col("bits").alias("b1"), F.col("doc_id").alias("d1")), "u")
    both = both.join(own.select(F.col("class").alias("v"), F.col("n").alias("n2"), F.col("bits").alias("b2"), F.col("doc_id").alias("d2")), "v")
    both = both.select("u", "v", "d1", "d2", (F.col("n1") + F.col("n2") - 2 * least_shared(F.col("n1"), F.col("n2"), percent)).cast("long").alias("most"), "b1", "b2")

    def near(batches):
        for batch in batches:
            most = batch.column(4).to_pylist()
            keep = [difference_bound(a, b) <= m for a, b, m in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)], names=["u", "v", "d1", "d2", "most"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(near, "u long, v long, d1 long, d2 long, most long")


def verified(pairs: DataFrame, docs: DataFrame, words: int, label: str) -> DataFrame:
    """Links among (u, v, d1, d2, most): the sets are made again from the candidates' texts.

    A bitmap of fixed size tells which texts are candidates; texts it lets through by chance
    meet no pair.
    """
    slots = 1 << FILTER_BITS

    def slot(ids: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(np.uint64) ^ mix(doc_ids.view(np.uint64))) % np.uint64(slots)).astype(np.int64)

    def mark(batches):
        total = np.zeros(slots // 64, np.uint64)
        for batch in batches:
            u, v, d1, d2 = (np.asarray(batch.column(i).fill_null(-1)).astype(np.int64) for i in range(4))
            for at in (slot(u, d1), slot(v, d2)):
                np.bitwise_or.at(total, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # sent as one count per bit, so that sums of tasks stay exact
        return np.unpackbits(total.view(np.uint8), bitorder="little").astype(np.int64)

    wanted = np.packbits(summed_vector(pairs.select("u", "v", "d1", "d2"), mark, slots) > 0)

    def emit(batches):
        for batch, texts in text_chunks(batches):
            who, h = shingle_sets(texts, words)
            ids = signed(class_ids(who, h, len(texts)))
            at = slot(ids, np.asarray(batch.column(0).fill_null(-1)).astype(np.int64))
            sizes = np.bincount(who, minlength=len(texts))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            found = np.flatnonzero((wanted[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) & (sizes > 0))
            sets = [h[starts[i] : starts[i + 1]].tobytes() for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(sets, pa.binary())], names=["class", "grams"])

    sets = stored(_rows(docs).mapInArrow(emit, "class long, grams binary").groupBy("class").agg(F.first("grams").alias("grams")), f"{label}-sets")
    both = pairs.select("u", "v", "most").join(sets.select(F.col("class").alias("u"), F.col("grams").alias("g1")), "u")
    both = both.join(sets.select(F.col("class").alias("v"), F.col("grams").alias("g2")), "v").select("u", "v", "most", "g1", "g2")

    def check(batches):
        for batch in batches:
            keep = []
            for most, a, b in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(len(x) + len(y) - 2 * shared <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "u long, v long")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(membership, links): (doc_id, n_shingles, class, component_id) per row, and class pairs.

    ``links`` holds a verified pair for every connection that was not derived from other links.
    """
    order = gram_order(docs, words)
    sets = stored(indexed_sets(docs, order, words, percent), "grams")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "prefix", "bits")).alias("m")
    classes = stored(sets.where("n > 0").groupBy("class").agg(first).select("class", "m.doc_id", "m.n", "m.prefix", "m.bits"), "classes")

    posts = classes.select("class", "n", F.posexplode("prefix").alias("pos", "gram"))
    leads = posts.groupBy("gram").agg(F.count("*").alias("k"), F.min(F.struct("pos", "class", "n")).alias("lead")).where("k > 1")
    posts = stored(posts.join(leads.select("gram", "lead"), "gram"), "posts")

    def may_link(n1, p1, n2, p2):
        need = least_shared(n1, n2, percent)
        return (n1 - p1 >= need) & (n2 - p2 >= need) & (F.least(n1, n2) >= need)

    near = posts.where("class <> lead.class").where(may_link(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    pairs = near.select(F.least("class", "lead.class").alias("u"), F.greatest("class", "lead.class").alias("v")).distinct()
    links = stored(verified(stored(_close_enough(pairs, classes, percent), "near"), docs, words, "first"), "links")

    found = components(links)
    of = found.select(F.col("node").alias("class"), F.col("component").alias("c"))
    own = stored(posts.select("class", "n", "pos", "gram").join(of, "class", "left").withColumn("c", F.coalesce("c", "class")), "own")
    # lists that already lie in one component need nothing more
    open_lists = own.groupBy("gram").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("gram")
    left = own.join(open_lists, "gram")
    a, b = left.alias("a"), left.alias("b")
    cross = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.c") != F.col("b.c")) & may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    cross = cross.select(F.col("a.class").alias("u"), F.col("b.class").alias("v")).distinct()
    more = stored(_close_enough(cross.join(pairs, ["u", "v"], "left_anti"), classes, percent), "near")
    rest = stored(verified(more, docs, words, "rest"), "links")
    links = links.union(rest)

    found = components(links)
    groups = found.join(classes.select(F.col("class").alias("node"), "doc_id"), "node")
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = groups.join(least, "component").select(F.col("node").alias("class"), "component_id")
    named = classes.select("class", "doc_id").join(named, "class", "left").select(F.col("class"), F.coalesce("component_id", "doc_id").alias("component_id"))
    full = sets.select("doc_id", "n", "class").join(named, "class", "left")
    member = full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return member, links


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of every component. Rows of one id are one
    document: all of them stay if one does.

    Documents without a word form no component and all stay.
    """
    member, _ = jaccard_join(docs, words, percent)
    kept = member.where("component_id = doc_id or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("row.*")


def jaccard_report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    return jaccard_join(docs, words, percent)[0].select("doc_id", "n_shingles", "component_id", "class")
