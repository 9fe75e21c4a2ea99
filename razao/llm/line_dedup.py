"""Lines that several documents share stay in the first one only.

Line keys are hashed, range-partitioned by (hash, document, position) and sorted within the
partitions. Each task streams its rows: the first document of a hash keeps its lines, later
ones lose them. Because the range key holds the document too, a very common line is spread
over many partitions; the first and last hash of each partition are settled in a second, small
step. Results travel as one compressed bitmap per document; text only meets its own bitmap.

Defined results: null and empty texts are one empty line; keys under ``min_chars`` code points
are never dropped; rows that share a doc_id are one document for the comparison (a line is not
dropped for another row of its own id) and rows are told apart by id and text; a null doc_id
takes no part and keeps all; other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.llm.common import WHITE, Texts, free_name, signed, stored, text_chunks, whole

MIN_CHARS = 10
CONTINUED = np.zeros(256, np.int64)
CONTINUED[128:192] = 1


def text_id() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, check, doc_id, text_id, pos) of every line whose key is long enough."""

    def split(batches):
        for batch, texts in text_chunks(batches):
            t = Texts(texts, fold=True)
            starts, ends, owner = t.lines()
            solid = np.flatnonzero(~WHITE[t.bytes])
            # strip: first and last byte of the line that is no white space
            at = np.searchsorted(solid, starts)
            last = np.searchsorted(solid, ends) - 1
            full = last >= at
            pos = np.arange(len(starts)) - np.searchsorted(owner, owner)
            begin, stop = solid[at[full]], solid[last[full]] + 1
            cont = np.concatenate([[0], np.cumsum(CONTINUED[t.bytes])])
            long = (stop - begin) - (cont[stop] - cont[begin]) >= min_chars
            begin, stop, own, pos = begin[long], stop[long], owner[full][long], pos[full][long]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(t.hashes(begin, stop))), pa.array(signed(t.hashes(begin, stop, 1)) >> 32, pa.int64()), batch.column(0).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array(pos, pa.int64())],
                names=["hash", "check", "doc_id", "text_id", "pos"],
            )

    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_id().alias("text_id"))
    return ids.mapInArrow(split, "hash long, check long, doc_id long, text_id long, pos long")


def _stream(batches):
    """Rows sorted by (hash, check, doc_id): drops, and what lies at the partition's ends.

    ``kind`` 0: drop this line. ``kind`` 1: a line of the first document that the partition
    holds for its first hash; ``kind`` 2: the first document of its last hash.
    """
    held, first = None, None
    for batch in batches:
        h, c, d, t, p = (np.asarray(batch.column(i)) for i in range(5))
        if not len(h):
            continue
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        if held is not None and (h[0], c[0]) == held[:2]:
            fresh[0] = False
        if first is None:
            first = (h[0], c[0])
        heads = np.concatenate([[held[2] if held is not None else 0], d[fresh]])
        least = heads[np.cumsum(fresh)]
        drop = d != least
        keep = drop | (h == first[0]) & (c == first[1])
        held = (int(h[-1]), int(c[-1]), int(least[-1]))
        if keep.any():
            yield _marks(np.where(drop[keep], 0, 1), h[keep], c[keep], d[keep], t[keep], p[keep])
    if held is not None:
        yield _marks(*(np.array([x]) for x in (2, *held, 0, -1)))


MARK = "kind int, hash long, check long, doc_id long, text_id long, pos long"


def _marks(kind, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *[pa.array(x, pa.int64()) for x in columns]], names=[f.split()[0] for f in MARK.split(", ")])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_id, pos) of the lines that a smaller doc_id holds as well.

    Lines are equal where 96 bits of their hashes are.
    """
    key = ["hash", "check"]
    hashes = line_hashes(docs, min_chars).select(*key, "doc_id", "text_id", "pos")
    ordered = hashes.repartitionByRange(*key, "doc_id", "pos").sortWithinPartitions(*key, "doc_id", "pos")
    marks = stored(ordered.mapInArrow(_stream, MARK), "lines")
    ends = marks.where("kind > 0")
    least = ends.groupBy(*key).agg(F.min("doc_id").alias("least"))
    late = ends.where("kind = 1").join(least, key).where("doc_id > least").select("doc_id", "text_id", "pos")
    return marks.where("kind = 0").select("doc_id", "text_id", "pos").union(late)


def keep_bitmaps(dropped: DataFrame, slice_lines: int = 1 << 16) -> DataFrame:
    """(doc_id, text_id, drops): zlib-compressed bits, one per line up to the last dropped one.

    Positions are first folded in slices of a fixed number of lines, so that a document of
    millions of dropped lines is compressed in pieces.
    """

    def packed(batches):
        for batch in batches:
            out = []
            for at in batch.column(3):
                pos = np.asarray(at.values) % slice_lines
                bits = np.zeros(int(pos.max()) + 1, np.uint8)
                bits[pos] = 1
                out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["doc_id", "text_id", "slice", "bits"])

    part = F.floor(F.col("pos") / slice_lines).cast("long").alias("slice")
    sliced = dropped.groupBy("doc_id", "text_id", part).agg(F.collect_set("pos").alias("at"))
    pieces = sliced.mapInArrow(packed, "doc_id long, text_id long, slice long, bits binary")
    return pieces.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("slice", "bits"))).alias("drops"))


def drop_positions(drops, slice_lines: int = 1 << 16) -> np.ndarray:
    """Line positions of a bitmap as ``keep_bitmaps`` makes it."""
    out = [np.zeros(0, np.int64)]
    for part in drops or ():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(part["bits"]), np.uint8))
        out.append(np.flatnonzero(bits) + part["slice"] * slice_lines)
    return np.concatenate(out)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` and, as the last column, each document's bitmap, null where all lines stay.

    The column is ``_drops``, or the next free name.
    """
    bitmaps = keep_bitmaps(dropped_lines(docs.select("doc_id", "text"), min_chars))
    bitmaps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("drops").alias("_drops"))
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("_at"), text_id().alias("_own"))
    joined = rows.join(bitmaps, (F.col("_at") == F.col("_id")) & (F.col("_own") == F.col("_text_id")), "left")
    return joined.select("row.*", F.col("_drops").alias(free_name(docs, "_drops")))


def _kept(text: bytes, drops) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    at = set(drop_positions(drops).tolist())
    if not at:
        return text, len(lines), 0
    return b"\n".join(line for i, line in enumerate(lines) if i not in at), len(lines), len(at)


def apply_bitmaps(marked: DataFrame) -> DataFrame:
    """The kept text in place of ``text``, for tables that ``line_dedup`` marked in their last column."""
    fields = marked.schema.fields[:-1]
    at = [f.name for f in fields].index("text")
    # numbered names inside, since a name may hold a dot
    names = [f"c{i}" for i in range(len(fields))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))

    def rebuild(batches):
        for batch, texts in text_chunks(batches, names[at]):
            drops = batch.column(len(names)).to_pylist()
            null = batch.column(at).is_null().to_pylist()
            out = [None if z else _kept(t, d)[0].decode() for t, d, z in zip(texts, drops, null, strict=True)]
            kept = [batch.column(i) for i in range(len(names))]
            kept[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=names)

    return marked.toDF(*names, "drops").mapInArrow(rebuild, schema).toDF(*[f.name for f in fields])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text."""
    marked = line_dedup(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_drops")

    def report(batches):
        for batch, texts in text_chunks(batches):
            rows = [_kept(t, d) for t, d in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return marked.mapInArrow(report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS least FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.*, coalesce(k.doc_id > f.least, false) AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
