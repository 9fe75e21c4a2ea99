"""Shards, source divergence and filter order against brute force and SQL."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from razao.llm import filter_audit, sharding, source_audit
from razao.llm.common import Texts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, term string, mask int, part string, rows long, id long"
LONG = " ".join(f"w{'abcdefghij'[i % 10] * (1 + i % 9)}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "One TWO two\nthree é É x1y2", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, LONG, "de", "b"), (5, "A" * 50_000 + "日本" * 2000, "de", "a"),
    (6, "same text", "en", "b"), (7, "same text", "en", "a"), (7, "same text", "de", "a"), (8, "same text", "", "c"), (None, "same text", "en", "b"), (None, "same text", "en", "b"),
    (9, "same row", "fr", "x"), (9, "same row", "fr", "x"), (10, " \t\n \x0b", "fr", None), (11, "AB CD | # EF", "en", "b"), (12, "a b c " * 100, "en", "c"),
    (13, "x　y \U0001F600 z_z [q] {r} @s `t`", "xx", "only"),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="module")
def odd(store):
    # enough copies that terms are kept, and a source with a third of all rows
    rows = ROWS + [(100 + i, f"common word {'rare' if i % 3 else 'odd'} é{i % 7}", ["en", "de"][i % 2], "hot" if i % 3 else f"s{i % 5}") for i in range(90)]
    return store.createDataFrame([(*r, None, 1, "s", "t", 2, "p", 3, 4) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(store):
    return store.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- 11


def plain_shard(key, weights):
    best = None
    for s, w in enumerate(weights):
        u = (int(md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        best = max(best or (-1.0, 0), (w / -math.log(u), s))
    return best[1]


def test_shards_and_slots(odd, empty):
    out = sharding.sharding(odd)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = [r.asDict() for r in out.collect()]
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(text(t)) + 16, zlib.crc32(text(t))) for i, t in rows_of(odd, "doc_id", "text"))
    slots = defaultdict(list)
    for r in got:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == plain_shard(key, [1.0] * 40) and r["grown_shard"] == plain_shard(key, [1.0] * 41)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharding(empty).collect() == []


def test_slots_of_hot_rows_in_small_slices(store):
    rows = store.range(30_000).select(F.when(F.col("id") < 25_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    plain = {(r.doc_id, r.shard, r.slot) for r in sharding.slots(rows).collect()}
    sliced = {(r.doc_id, r.shard, r.slot) for r in sharding.slots(rows, slice_rows=10).collect()}
    assert plain == sliced and len(plain) == 30_000


def test_weights_and_moves(store, tmp_path):
    keys = store.range(20_000).withColumnRenamed("id", "doc_id")
    three = [1.0, 2.0, 0.0, 1.0]
    held = Counter(r.shard for r in sharding.with_shard(keys, three).collect())
    assert held[2] == 0 and abs(held[1] / 20_000 - 0.5) < 0.02 and abs(held[0] / 20_000 - 0.25) < 0.02
    grown = sharding.moved(keys, three, [*three, 1.0]).collect()
    assert {r.to_shard for r in grown} == {4} and abs(sum(r.rows for r in grown) / 20_000 - 0.2) < 0.02
    gone = sharding.moved(keys, three, [1.0, 2.0, 0.0, 0.0]).collect()
    assert {r.from_shard for r in gone} == {3}
    heavier = sharding.moved(keys, three, [1.0, 3.0, 0.0, 1.0]).collect()
    assert {r.to_shard for r in heavier} == {1}
    with pytest.raises(ValueError):
        sharding.with_shard(keys, [0.0])


def test_written_shards_hold_every_row_and_column(store, odd, tmp_path):
    path = str(tmp_path / "shards")
    name = sharding.write_shards(odd, path, (1.0,) * 5, file_rows=7)
    assert name == "shard_2"
    back = store.read.parquet(path)
    assert sorted(map(str, rows_of(back, *odd.columns))) == sorted(map(str, rows_of(odd)))
    assert all(r.shard_2 == plain_shard("" if r.doc_id is None else r.doc_id, [1.0] * 5) for r in back.collect())
    assert sharding.with_shard(odd).columns == [*odd.columns, "shard_2"]


# ---------------------------------------------------------------- 12


def plain_audit(rows, min_docs=10):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        shares, q = {s: p(counts[lang, s]) for s in sources}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(shares[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(items)[:top])}
    return out


def test_source_audit(store, odd, empty):
    documents = store.read.parquet(f"{SF}/documents.parquet")
    for df, min_docs in ((odd, 10), (odd, 2), (documents, 10)):
        got = rows_of(source_audit.source_audit(df, min_docs))
        assert len(got) == len(set(got)) and set(got) == plain_audit(rows_of(df, "text", "lang", "source"), min_docs)
    assert source_audit.source_audit(empty).collect() == []


def test_pairs_in_small_blocks_and_slices(store, odd):
    kept = source_audit.kept_counts(source_audit.term_counts(odd), 2).cache()
    totals = source_audit.group_totals(odd, kept).cache()
    whole = set(rows_of(source_audit.pair_values(kept, totals)))
    assert set(rows_of(source_audit.pair_values(kept, totals, terms_a_slice=3, sources_a_block=2))) == whole


def test_pointer_sort():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(3000)] + ["a" * k for k in (7, 8, 9, 15, 16, 17, 24, 25)] * 3
    t = Texts([" ".join(words[i : i + 40]).encode() for i in range(0, len(words), 40)], fold=True)
    starts, lengths, _ = source_audit.term_pointers(t)
    order, fresh = source_audit.sort_pointers(t, starts, lengths)
    raw = t.bytes.tobytes()
    got = [raw[s : s + n] for s, n in zip(starts[order].tolist(), lengths[order].tolist(), strict=True)]
    assert got == sorted(w.encode() for w in words)
    assert fresh.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_shares_are_floored_exactly(store):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(c + rng.integers(0, 10**14)), int(v)) for c, v in zip(rng.integers(0, 10**14, 300), rng.integers(1, 10**6, 300), strict=True)] + [(0, 0, 1), (5, 5, 1)]
    got = store.createDataFrame(rows, "n long, total long, terms long").select(source_audit.share(F.col("n"), F.col("total"), F.col("terms"))).collect()
    want = [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
    assert [r[0] for r in got] == want
    assert [int(source_audit.shares(np.array([c]), np.array([n]), v)[0]) for c, n, v in rows] == want


# ---------------------------------------------------------------- 13


def plain_filters(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        parts[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(docs)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(store, odd, empty):
    labels = store.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, None), (7, 1, 1), (9, 1, 0), (None, 1, 1), (11, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(filter_audit.filter_audit(odd, labels))
    want = plain_filters(rows_of(odd, "doc_id", "text", "lang"), rows_of(labels))
    assert len(got) == len(want) and set(got) == want
    assert filter_audit.filter_audit(empty, labels).collect() == []
    none = filter_audit.filter_audit(odd, labels.where("false"))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_masks_of_a_table_with_a_hot_text(store):
    docs = store.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    cells, letters = filter_audit.mask_cells(docs, store.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert letters == "ABCDE"
    assert {(r["mask"], r["rows"]) for r in cells.collect()} == {(1, 2001), (17, 999)}


# ---------------------------------------------------------------- names


CLASHING = (
    "_source", "_lang", "_topic", "_rate", "_drops", "_id", "_own", "_at", "_text_id", "_good", "_kept", "row", "rate", "sum", "weight", "tokens", "target_source",
    "hash", "check", "class", "pos", "cluster", "piece", "bin_id", "shard", "component", "component_id", "node", "u", "v", "words", "score", "lang_pred", "salt", "a.b",
)


@pytest.fixture(scope="module")
def clashing(store):
    docs = store.read.parquet(f"{SF}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{name}:"), F.col("doc_id")).alias(name) for name in CLASHING]).cache()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(store, clashing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = store.read.parquet(f"{SF}/documents.parquet")
    out, want = run(store, clashing, SF), run(store, plain, SF)
    if stage == "best_fit_packing":
        assert out.count() == want.count()
        return
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, map(tuple, want.collect())))
    assert all(tuple(r)[5:] == tuple(f"{name}:{r.doc_id}" for name in CLASHING) for r in rows)
