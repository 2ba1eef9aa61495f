"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

Every window of ``size`` consecutive words of a document is hashed. A window is removed when
the same words also start in a document with a smaller id; the removed windows of a document
merge into maximal intervals of words.

How it is spread out:

* Each task hashes all windows of its rows with array operations. Of windows that are equal
  inside one task, those of the smallest id go on; the others are decided at once. So a passage
  that a third of all documents share is sent once per task, not once per document.
* A window goes to the bucket of its *anchor*, the smallest hash of the ``ANCHOR`` word runs
  inside it. Equal windows have equal anchors, and neighbours mostly share one, so windows
  travel as runs: 8 bytes each, and one position per run.
* A bucket is sorted by hash; every window whose hash has a smaller id in the bucket is
  removed. Anchor and window hash are compared both, so two different windows pass as equal
  only if they share their anchor and 64 more bits by chance.
* The intervals, merged, go back to the rows by a join; texts are shuffled once.

Defined cases: null or empty texts and texts with fewer than ``size`` words lose nothing. Rows
with a null id have no place in the order: they lose nothing and remove nothing. Rows with
equal ids are one document: they remove nothing from each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ids_of, mixed, rolling, runs, slices, splits, spread, string_parts

#: Words of a window.
WINDOW = 50
#: Words of an anchor.
ANCHOR = 8
#: Words that a task hashes before it sends windows off.
FLUSH_WORDS = 800_000
_WORD_BASE, _ANCHOR_BASE = 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35
_SENT = "bucket long, decided boolean, ids binary, keys binary, starts binary, lengths binary, anchors binary, hashes binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("decided", pa.bool_())] + [(c, pa.binary()) for c in ("ids", "keys", "starts", "lengths", "anchors", "hashes")])
_CUT = "doc_id long, key long, spans array<struct<lo:int,hi:int>>"
_CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours: block-wise minima from both ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _pieces(doc: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of consecutive positions of one document with the same ``more``."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = runs(doc, pos - np.arange(len(pos)), *more)
    return first, np.diff(np.append(first, len(doc)))


def _windows(size: int, buckets: int, flush_words: int):
    """The task's side: rows of packed windows by bucket, and decided runs."""

    def flush(docs: list[tuple]) -> Iterator[dict]:
        ids, keys, counts, hashes = (np.concatenate(x) for x in zip(*docs, strict=True))
        if len(hashes) < size:
            return
        window = rolling(hashes, size, _WORD_BASE)
        anchor_words = min(ANCHOR, size)
        anchor = _lowest(rolling(hashes, anchor_words, _ANCHOR_BASE), size - anchor_words + 1)
        last = np.cumsum(counts)
        doc = np.repeat(np.arange(len(ids)), np.maximum(counts - size + 1, 0))
        at = spread(last - counts, np.maximum(counts - size + 1, 0))
        if not len(at):
            return
        pos = at - (last - counts)[doc]
        window, anchor, number = window[at], anchor[at], ids[doc]
        order = np.lexsort((number, window))
        head = runs(window[order])
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(number[order][head], np.diff(np.append(head, len(order))))
        for decided in (True, False):
            pick = np.flatnonzero((number > least) if decided else (number == least))
            if not len(pick):
                continue
            extra = () if decided else (anchor[pick],)
            first, length = _pieces(doc[pick], pos[pick], *extra)
            run = pick[first]
            where = (mixed(keys[doc[run]].view(np.uint64)) if decided else mixed(anchor[run])) % np.uint64(buckets)
            by = np.argsort(where, kind="stable")
            cut = runs(where[by])
            for lo, hi in zip(cut, np.append(cut[1:], len(by)), strict=True):
                mine = by[lo:hi]
                inside = pick[spread(first[mine], length[mine])] if not decided else pick[:0]
                yield {
                    "bucket": int(where[mine[0]]), "decided": decided,
                    "ids": ids[doc[run[mine]]].tobytes(), "keys": keys[doc[run[mine]]].tobytes(),
                    "starts": pos[run[mine]].astype(np.int32).tobytes(), "lengths": length[mine].astype(np.int32).tobytes(),
                    "anchors": b"" if decided else anchor[run[mine]].tobytes(), "hashes": window[inside].tobytes(),
                }

    def gathered(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        """Few batches with many rows instead of one batch for each bucket."""
        for some in batched(rows, 512):
            yield pa.RecordBatch.from_pylist(list(some), _SENT_ARROW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            ids, gone = ids_of(batch.column("doc_id"))
            keys, _ = ids_of(batch.column("key"))
            for a, b in slices(offsets):
                part = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                use = ~gone[a:b] & (part.counts >= size)
                kept = np.repeat(use, part.counts)
                held.append((ids[a:b][use], keys[a:b][use], part.counts[use], part.hashes()[kept]))
                words += int(part.counts[use].sum())
                if words >= flush_words:
                    yield from gathered(flush(held))
                    held, words = [], 0
        if held:
            yield from gathered(flush(held))

    return task


def _judged(size: int):
    """A bucket's side: which windows have a smaller id with the same words; spans of words by document."""

    def judge(table: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        ids, keys, starts, lengths, anchors, hashes = [], [], [], [], [], []
        for row in table.to_pylist():
            i, k = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
            s, n = np.frombuffer(row["starts"], np.int32).astype(np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            if row["decided"]:
                out.append(np.stack([i, k, s, s + n - 1 + size]))
                continue
            for held, x in zip((ids, keys, starts, lengths, anchors, hashes), (i, k, s, n, np.frombuffer(row["anchors"], np.uint64), np.frombuffer(row["hashes"], np.uint64)), strict=True):
                held.append(x)
        if ids:
            i, k, s, n, anchor, window = (np.concatenate(x) for x in (ids, keys, starts, lengths, anchors, hashes))
            run = np.repeat(np.arange(len(i)), n)
            number = i[run]
            order = np.lexsort((number, anchor[run], window))
            head = runs(window[order], anchor[run][order])
            least = np.repeat(number[order][head], np.diff(np.append(head, len(order))))
            gone = np.zeros(len(order), bool)
            gone[order] = number[order] > least
            at = np.flatnonzero(gone)
            pos = spread(s, n)[at]
            first, length = _pieces(run[at], pos)
            mine = run[at[first]]
            out.append(np.stack([i[mine], k[mine], pos[first], pos[first] + length - 1 + size]))
        if not out:
            return _CUT_ARROW.empty_table()
        i, k, lo, hi = np.concatenate(out, axis=1)
        order = np.lexsort((lo, k, i))
        i, k, lo, hi = i[order], k[order], lo[order], hi[order]
        head = runs(i, k) if len(i) else np.empty(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["lo", "hi"])
        return pa.table([pa.array(i[head]), pa.array(k[head]), pa.ListArray.from_arrays(pa.array(np.append(head, len(i)).astype(np.int32)), spans)], schema=_CUT_ARROW)

    return judge


def repeated_spans(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", flush_words: int = FLUSH_WORDS) -> DataFrame:
    """doc_id, key, spans: for each document that loses words, its removal intervals [lo, hi) in words, not yet merged.

    ``key`` is xxhash64 of the text: together with the id it finds the row again where ids repeat.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    buckets = min(8 * splits(rows), 1 << 20)
    sent = rows.mapInArrow(_windows(size, buckets, flush_words), _SENT)
    found = sent.groupBy("bucket").applyInArrow(_judged(size), _CUT)
    return found.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<lo:int,hi:int>>, kept string"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _CUT_ARROW.field("spans").type), ("kept", pa.string())])


def merged(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Intervals [lo, hi) joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            for a, b in slices(offsets):
                words = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                # Words packed with one space behind each: a kept range of words is then one slice.
                wide = words.ends - words.starts + 1
                packed = np.full(int(wide.sum()), 32, np.uint8)
                begin = np.append(0, np.cumsum(wide))
                packed[spread(begin[:-1], wide - 1)] = words.data[spread(words.starts, wide - 1)]
                raw = packed.tobytes()
                rows = []
                for r in range(a, b):
                    f, n = int(words.first[r - a]), int(words.counts[r - a])
                    gone = merged([s["lo"] for s in spans[r]], [s["hi"] for s in spans[r]]) if spans[r] else []
                    edges = [0, *(x for s in gone for x in s), n]
                    parts = [raw[begin[f + x]:begin[f + y] - 1] for x, y in zip(edges[::2], edges[1::2], strict=True) if y > x]
                    kept = b" ".join(parts)
                    rows.append((n, sum(y - x for x, y in gone), hashlib.sha256(kept).hexdigest(), [{"lo": x, "hi": y} for x, y in gone], kept.decode("utf-8", "replace") if with_text else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(cols, list(_KEPT_ARROW)[1:], strict=True))], schema=_KEPT_ARROW)

    return task


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, flush_words: int = FLUSH_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (merged), kept (null unless ``with_text``)."""
    spans = repeated_spans(docs, size, id_col, text_col, flush_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(with_text), _KEPT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 50 words over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM p
), m AS (
  SELECT k, min(doc_id) AS d FROM h GROUP BY k
), r AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN m USING (k) WHERE h.doc_id > m.d
), g AS (
  SELECT doc_id, list(j) AS js, count(*) AS n FROM r GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS t FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.j WHERE r.j IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""
