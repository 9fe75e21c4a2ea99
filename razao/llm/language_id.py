"""Language of a text and of its parts.

Scripts narrow the candidate languages of a word, hashed letter n-grams and whole words score
it per candidate, and Viterbi with a penalty for switching labels spans of the text. A text's
language is the one whose spans hold the most bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties between
languages go to the first in alphabetical order; words without letters are neutral; a word in a
script that no learned language uses keeps all candidates; without any learned language
every text is ``und``; repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import WHITE, Texts, bucket_of, mix, summed_vector, text_chunks, whole

SLOTS = 1 << 16
SWITCH = 12.0
OUTSIDE = -60.0  # added for languages that do not use the word's script
MIN_SCRIPT_SHARE = 0.01

# First code points of Unicode script blocks, up to the next entry.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters; code points past the table are looked up one by one."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of every code point of valid UTF-8."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    value = raw[at].astype(np.int64)
    long = np.flatnonzero(value >= 0x80)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    b0, b1, b2, b3 = (padded[at[long] + k].astype(np.int64) for k in range(4))
    value[long] = np.where(b0 < 0xE0, (b0 & 31) << 6 | (b1 & 63), np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | (b2 & 63), (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | (b3 & 63)))
    return at, value


@dataclass
class Measured:
    """The words of a chunk, with the slots of their features."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    script: np.ndarray  # per word, -1: no letter
    grams: np.ndarray  # per byte inside words
    first_gram: np.ndarray  # per word
    word_slot: np.ndarray


def measure(texts: list[bytes]) -> Measured:
    t = Texts(texts, fold=True)
    starts, ends, owner = t.words()
    at, value = _code_points(t.bytes)
    table = _letters()
    letter = table[np.minimum(value, len(table) - 1)]
    for i in np.flatnonzero(value >= len(table)):
        letter[i] = chr(int(value[i])).isalpha()
    at, value = at[letter], value[letter]
    # script of a word's first letter
    found = np.searchsorted(at, starts)
    has = found < len(at)
    has[has] = at[found[has]] < ends[has]
    script = np.full(len(starts), -1)
    script[has] = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, value[found[has]], "right") - 1]
    plain = np.concatenate([[32], np.where(WHITE[t.bytes], 32, t.bytes), [32]]).astype(np.uint64)
    solid = np.flatnonzero(~WHITE[t.bytes])
    grams = plain[solid] << np.uint64(16) | plain[solid + 1] << np.uint64(8) | plain[solid + 2]
    slots = (mix(grams + np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    words = (t.hashes(starts, ends) & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS
    return Measured(t, starts, ends, owner, script, slots, first, words)


@dataclass
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (2 * SLOTS, languages)
    allowed: np.ndarray  # (scripts, languages)

    @functools.cached_property
    def columns(self) -> np.ndarray:
        """The weights of one language side by side."""
        return np.ascontiguousarray(self.weights.T)


def train(docs: DataFrame, lang: str = "lang") -> Model:
    """Counts of n-grams, words and scripts per language, over all rows with a language."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("_lang"))
    languages = tuple(sorted(r[0] for r in rows.select("_lang").distinct().collect()))
    n, width = len(languages), 2 * SLOTS + len(SCRIPT_NAMES)
    if not n:
        return Model((), np.zeros((2 * SLOTS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((n, width), np.int64)
        for batch, texts in text_chunks(batches):
            m = measure(texts)
            own = np.array([number[v] for v in batch.column(1).to_pylist()])
            of_word = own[m.owner]
            of_gram = np.repeat(of_word, m.ends - m.starts)
            has = m.script >= 0
            for i in np.unique(own):
                w = (of_word == i) & has
                total[i, :SLOTS] += np.bincount(m.grams[of_gram == i], minlength=SLOTS)
                total[i, SLOTS : 2 * SLOTS] += np.bincount(m.word_slot[w] - SLOTS, minlength=SLOTS)
                total[i, 2 * SLOTS :] += np.bincount(m.script[w], minlength=len(SCRIPT_NAMES))
        return total.ravel()

    counts = summed_vector(rows, count, n * width).reshape(n, width).T.astype(float)
    parts = []
    for block in (counts[:SLOTS], counts[SLOTS : 2 * SLOTS]):
        p = np.log((block + 0.5) / (block.sum(0) + 0.5 * SLOTS))
        parts.append(p - p.mean(1, keepdims=True))
    used = counts[2 * SLOTS :]
    return Model(languages, np.concatenate(parts).astype(np.float32), used >= MIN_SCRIPT_SHARE * np.maximum(used.sum(0), 1))


def word_scores(m: Measured, model: Model) -> np.ndarray:
    """(words, languages): sum of the features' weights; languages outside the script lose."""
    n = len(model.languages)
    out = np.zeros((len(m.starts), n))
    if not len(out):
        return out
    for k, weights in enumerate(model.columns):
        out[:, k] = np.add.reduceat(weights.take(m.grams), m.first_gram) + weights.take(m.word_slot)
    out[m.script < 0] = 0
    has = np.flatnonzero(m.script >= 0)
    allowed = model.allowed[m.script[has]]
    out[has] += np.where(allowed | ~allowed.any(1, keepdims=True), 0, OUTSIDE)
    return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best path of one text: its words' scores less ``switch`` for every change."""
    best = np.zeros(scores.shape[1])
    stay = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int64)
    for t, s in enumerate(scores):
        if t:
            top = int(best.argmax())
            stay[t] = best >= best[top] - switch
            came[t] = top
            best = np.where(stay[t], best, best[top] - switch)
        best = best + s
    path = np.zeros(len(scores), np.int64)
    at = int(best.argmax()) if len(scores) else 0
    for t in range(len(scores) - 1, -1, -1):
        path[t] = at
        if t and not stay[t, at]:
            at = came[t]
    return path


def paths(m: Measured, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of every text of the chunk.

    The text's best single language is the whole path unless a run of words gains more than
    the penalty over it, or a run from the start and one to the end do together: a stretch of r
    other languages costs r changes at least, or r - 1 where it is the whole text. Only texts
    that may change are walked word by word.
    """
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    first = np.flatnonzero(np.concatenate([[True], m.owner[1:] != m.owner[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(scores)]]))
    best = np.repeat(np.add.reduceat(scores, first).argmax(1), sizes)
    out[:] = best
    text = np.repeat(np.arange(len(first)), sizes)
    run, head, tail = (np.full(len(first), -np.inf) for _ in range(3))
    last = first + sizes - 1
    base = scores[np.arange(len(scores)), best]
    for k in range(scores.shape[1]):
        gain = scores[:, k] - base
        after = np.cumsum(gain)
        before = after - gain
        start = np.repeat(before[first], sizes)
        after, before = after - start, before - start
        far = 2 * (np.abs(after).max() + np.abs(before).max()) + 1
        low = np.minimum.accumulate(before - text * far) + text * far
        run = np.maximum(run, np.maximum.reduceat(after - low, first))
        head = np.maximum(head, np.maximum.reduceat(after, first))
        tail = np.maximum(tail, after[last] - np.minimum.reduceat(before, first))
    for i in np.flatnonzero((run > switch) | (head + tail > switch)):
        part = slice(first[i], first[i] + sizes[i])
        out[part] = viterbi(scores[part], switch)
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and the spans as (language, first word, words)."""
    names = np.array([*model.languages, "und"])

    def label(batches):
        for batch, texts in text_chunks(batches):
            m = measure(texts)
            n, k = len(texts), len(model.languages)
            lettered = np.bincount(m.owner[m.script >= 0], minlength=n) > 0
            if not k:
                lettered[:] = False
            scores = word_scores(m, model)
            path = paths(m, scores, switch)
            share = np.zeros((n, max(k, 1)))
            weight = np.where(m.script >= 0, m.ends - m.starts, 0)
            np.add.at(share, (m.owner, path), weight)
            pred = np.where(lettered, share.argmax(1), k)
            score = np.where(lettered, share.max(1) / np.maximum(share.sum(1), 1), 0.0)
            spans: list[list] = [[] for _ in range(n)]
            change = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (m.owner[1:] != m.owner[:-1])])) if len(path) else []
            stop = np.concatenate([change[1:], [len(path)]]) if len(path) else []
            head = np.searchsorted(m.owner, np.arange(n))
            for a, b in zip(change, stop, strict=True):
                doc = m.owner[a]
                if lettered[doc]:
                    spans[doc].append({"lang": str(names[path[a]]), "first": int(a - head[doc]), "words": int(b - a)})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:bigint,words:bigint>>")


def held_out(docs: DataFrame) -> Column:
    return bucket_of(docs["doc_id"], 4) == 2


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the ids, label every document."""
    model = train(docs.where(~held_out(docs)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is known and holds at least ``min_score`` of the text.

    Rows with the same id go together: all stay if one of them does.
    """
    model = train(docs.where(~held_out(docs)))
    good = identify(docs.select("doc_id", "text"), model).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    good = good.select(F.col("doc_id").alias("_good")).distinct()
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(good, F.col("_id").eqNullSafe(F.col("_good")), "left_semi").select("row.*")
