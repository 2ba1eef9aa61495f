"""Exact Jaccard self-join of word n-gram sets, with skipping by set relations.

A document's set: its distinct shingles of ``SHINGLE`` words (lower case for A-Z only), or its whole
sequence if it has fewer words. Two sets link when 100 x intersection >= ``PERCENT`` x union. The
result is each document's component over links.

Sets and their relations:

* Equal sets are one node, named by a 64-bit fingerprint; all that follows is between nodes.
* A set's shingles are put in one order for all sets, frequent ones last. What two sets that link don't share cuts the
  shingles that they do share into few runs, so among their first 2 (1 - PERCENT/100) n + 2 shingles two shared ones stand
  side by side in both sets. The index holds these neighbours: one shingle is shared by chance ever more
  often as a table grows, two side by side hardly. Below 79 percent single shingles are indexed, the first n - ceil(PERCENT/100 n) + 1 (see ``entries``).
  Which shingles count as frequent (at most ``HOT_LIST`` of them, the most frequent) only decides the
  order: any choice gives the same links.
* *Index skipping*: an index list is sorted by set size and cut into blocks by position. The words
  before and behind the positions bound an intersection, so pairs and whole blocks that can't link are passed
  over. A parity sketch of each set (how many shingles fall into each of its bins, modulo 2; 512 bins, or
  as many as shingles) bounds the symmetric difference from below and drops most of what is left, never a link.
* *Answer skipping*: the sets of a long index list are nearly all copies
  of each other, so they aren't paired. Each long list has a hub, its first set.
  A set is compared with its hubs once, and its difference to a hub is kept. Two sets x and y of a hub
  r have |x & y| = |r| - |r\\x| - |r\\y| + |r\\x & r\\y| + |x\\r & y\\r|, which is derived from the kept
  answers; only sets that don't hang together with the hub yet are compared that way, in blocks.

* Links are counted component by component: a set of each is compared with all others of it, and all other
  answers are derived from those differences, in cells that hand on numbers, not pairs.

First each set is compared with its most similar candidate and its hubs; pairs that already hang
together need no comparison. So no group of copies is expanded into pairs.

Nothing is collected but the frequent shingles (``HOT_LIST`` at most) and a filter of 2^26 bits. Hubs' rows are dealt out by
joins that adaptive execution splits, and by blocks of ``BLOCK`` sets.

Defined cases: null and empty texts and texts of white space have no shingle, link with nothing and
are components of their own. Rows with a null id take part; a component's name is its smallest id
that isn't null, or null if there is none. Rows with equal ids are rows of their own. Two sets with the same size and
fingerprint (64 bits) are taken as equal, and shingles are compared by 64-bit hashes. An empty table gives no row. Texts are used
whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, rolling, runs, scratch, slices, splits, spread, string_parts, written
from .components import components

SHINGLE = 4
PERCENT = 85
#: A shingle is frequent if tasks saw it in this many sets, counting where one saw it twice; at most this many are.
HOT_SETS = 4
HOT_LIST = 200_000
BLOCK = 1024
#: Bins of a sketch: at least so many, and at most, whatever the set's size.
SKETCH_BITS = 512
MOST_BITS = 1 << 16
#: Shingles that a task holds before it sends them; bounds its memory, changes no answer.
FLUSH_WORDS = 800_000
#: Logarithm of the bits of the filter that picks the texts to be compared.
FILTER_BITS = 26
#: Entries of an index list from which it is skipped by blocks, and from which its sets meet by way of a hub.
LONG_LIST = 32
HUB_LIST = 64
#: Sets of a block when links are counted.
CELL = 512
_BASE = 0xB5297A4D3F84D5B5


def needed(nx, ny, percent: int = PERCENT):
    """Smallest intersection with which sets of these sizes link."""
    return -(-percent * (nx + ny) // (100 + percent))


def run_length(percent: int) -> int:
    """How many neighbouring shingles an index entry has; two where every set that links with another one has enough of them."""
    return 2 if 2 * percent * percent + 100 * percent >= 20_000 else 1


def entries(counts: np.ndarray, percent: int, run: int) -> np.ndarray:
    """How many index entries sets of these sizes need.

    With D(x) and D(y) the numbers of shingles that only x or only y has, sets that link have D(x) + p D(y) <= (1 - p) n(x). Where
    the first of the two prefixes ends, say that of x, the shared shingles are cut by the others into D(x) + D(y) + 1 runs
    at most; if P(x) - D(x) of them exceed that, two are side by side. 2 D(x) + D(y) <= 2 (1 - p) n(x) gives the prefix
    P(x) = 2 (1 - p) n(x) + 2. Sets with (1 - p) n < p link with equal ones alone.
    """
    if run == 1:
        return np.where(counts > 0, counts - (percent * counts + 99) // 100 + 1, 0)
    return np.where((100 - percent) * counts >= percent, 2 * (100 - percent) * counts // 100 + 1, 0)


def most_shared(pos_x, pos_y, left_x, left_y, run: int):
    """No fewer than sets share whose first common index entry is at these positions, ``left`` shingles from there on."""
    # Before the first two neighbours shared ones stand alone: at least as many others, less one, are between them.
    return np.minimum(left_x, left_y) + (np.minimum(np.minimum(pos_x, pos_y), (pos_x + pos_y + 1) // 3) if run == 2 else 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all rows, sorted within each row; number of shingles of each row)."""
    words = Words(data, offsets, lower=True)
    hashes, counts, first = words.hashes(), words.counts, words.first[:-1]
    rolled = rolling(hashes, shingle, _BASE)
    per = np.maximum(counts - shingle + 1, 0)
    found, rows = [rolled[spread(first, per)]], [np.repeat(np.arange(len(counts)), per)]
    for n in range(1, shingle):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(mixed(rolling(hashes, n, _BASE)[first[short]] + np.uint64(n)))
            rows.append(short)
    value, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    head = runs(row, value)
    return value[head], np.bincount(row[head], minlength=len(counts))


def fingerprints(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each set that doesn't depend on an order."""
    upto = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mixed(value + np.uint64(0x632BE59BD9B4E019)), out=upto[1:])
    edge = np.append(0, np.cumsum(counts))
    return mixed(upto[edge[1:]] - upto[edge[:-1]] + mixed(counts.astype(np.uint64))).view(np.int64)


def sketches(value: np.ndarray, counts: np.ndarray, bits: int = SKETCH_BITS, most: int = MOST_BITS) -> list[bytes]:
    """Parities of each set's bins. ``bits`` of them are doubled until there are as many as shingles: fewer would rule out no pair of long sets."""
    width = np.full(len(counts), bits)
    while (grow := (width < counts) & (width < most)).any():
        width[grow] *= 2
    edge = np.append(0, np.cumsum(width))
    flat = np.repeat(edge[:-1], counts) + (value & np.repeat(width - 1, counts).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(flat, minlength=edge[-1]) & 1).astype(bool)).tobytes()
    return [packed[x:y] for x, y in zip((edge[:-1] // 8).tolist(), (edge[1:] // 8).tolist(), strict=True)]


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bins each two sketches differ; the wider one's halves are laid over each other until both have the same bins."""
    size = np.array([[len(v) for v in x], [len(v) for v in y]], np.int64).reshape(2, -1)
    out = np.zeros(len(x), np.int64)
    for m, n in np.unique(size, axis=1).T.tolist():
        at = np.flatnonzero((size[0] == m) & (size[1] == n))
        a, b = (np.frombuffer(b"".join([v[k] for k in at.tolist()]), np.uint64).reshape(len(at), -1) for v in (x, y))
        while a.shape[1] != b.shape[1]:
            wide, b = (a, b) if a.shape[1] > b.shape[1] else (b, a)
            a = wide[:, :wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2:]
        out[at] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


_FIRST = "doc_id long, fp long, n int, sketch binary, hot boolean, token long, sets long"
_FIRST_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("hot", pa.bool_()), ("token", pa.int64()), ("sets", pa.int64())])


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _surveyed(shingle: int, flush_words: int):
    """For each document its node, size and sketch; for shingles that a task saw in two sets, how many."""

    def counted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        value, fp, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one = np.unique(fp, return_index=True)
        mine = np.zeros(len(fp), bool)
        mine[one] = True  # equal sets count once
        kept = np.repeat(mine, counts)
        value = np.sort(value[kept])
        head = runs(value)
        sets = np.diff(np.append(head, len(value)))
        head, sets = head[sets > 1], sets[sets > 1]
        for a in range(0, len(head), 50_000):
            h = head[a:a + 50_000]
            yield _batch(_FIRST_ARROW, len(h), hot=pa.array([True] * len(h)), token=pa.array(value[h].view(np.int64)), sets=pa.array(sets[a:a + 50_000]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in slices(offsets):
                value, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                fp, sketch = fingerprints(value, counts), sketches(value, counts)
                yield _batch(_FIRST_ARROW, b - a, doc_id=batch.column("doc_id").slice(a, b - a), fp=pa.array(fp), n=pa.array(counts.astype(np.int32)), sketch=pa.array(sketch, pa.binary()), hot=pa.array([False] * (b - a)))
                held.append((value, fp, counts))
                size += len(value)
                if size >= flush_words:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    return task


class HotList:
    """Frequent shingles and their rank (rarest first)."""

    def __init__(self, token: np.ndarray, sets: np.ndarray):
        rank = np.empty(len(token), np.int64)
        rank[np.lexsort((token, sets))] = np.arange(1, len(token) + 1)
        order = np.argsort(token.view(np.uint64))
        self.token, self.rank = token.view(np.uint64)[order], rank[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.token >> np.uint64(42)).astype(np.int64)] = True

    def places(self, value: np.ndarray) -> np.ndarray:
        """Place of each shingle in the list, or -1."""
        out = np.full(len(value), -1, np.int64)
        if len(self.token):
            maybe = np.flatnonzero(self.seen[(value >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.token, value[maybe]), len(self.token) - 1)
            hit = self.token[at] == value[maybe]
            out[maybe[hit]] = at[hit]
        return out


_PACKED = "bucket long, a binary, b binary, n binary, pos binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("a", "b", "n", "pos")])


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones: the high ones of small numbers are alike and take no room in a shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _indexed(shingle: int, percent: int, buckets: int, flush_words: int, shared):
    """First neighbours (or single shingles) of every set, packed by the bucket of their hash.

    Inside its bucket half of the hash stands for it: two that are mixed up make a candidate more, never one less.
    """
    run = run_length(percent)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        value, fp, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one = np.unique(fp, return_index=True)
        mine = np.zeros(len(fp), bool)
        mine[one] = True
        value, fp, counts = value[np.repeat(mine, counts)], fp[mine], counts[mine]
        row = np.repeat(np.arange(len(fp)), counts)
        place = hot.places(value)
        rank = np.where(place >= 0, hot.rank[place] if len(hot.rank) else 0, 0)
        value = value[np.lexsort((value, rank, row))]
        first = np.cumsum(counts) - counts
        use = entries(counts, percent, run)
        at = spread(first, use)
        row, pos = row[at], (at - np.repeat(first, use)).astype(np.int32)
        key = value[at] if run == 1 else mixed(value[at] + mixed(value[at + 1]))
        bucket, n = key % np.uint64(buckets), counts.astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        bucket, half = bucket[by], (key >> np.uint64(32)).astype(np.uint32)
        cut = np.append(runs(bucket), len(by)).tolist()
        rows = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            e = by[lo:hi]
            rows.append({"bucket": int(bucket[lo]), "a": _planes(fp[row[e]]), "b": _planes(half[e]), "n": _planes(n[row[e]]), "pos": _planes(pos[e])})
            if len(rows) == 512:
                yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in slices(offsets):
                value, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                held.append((value, fingerprints(value, counts), counts))
                size += len(value)
                if size >= flush_words:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return task


def list_pairs(n: np.ndarray, pos: np.ndarray, percent: int = PERCENT, block: int = 32, run: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an index list's entries that may link, by blocks of like positions: whole blocks are skipped."""
    order = np.lexsort((n, pos))
    n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
    left = n - pos  # shingles from here on
    cuts = list(range(0, len(n), block))
    low = [int(n[c:c + block].min()) for c in cuts]
    high = [int(n[c:c + block].max()) for c in cuts]
    most = [int(left[c:c + block].max()) for c in cuts]
    last = [int(pos[c:c + block].max()) for c in cuts]
    out_i, out_j = [], []
    for p, a in enumerate(cuts):
        for q in range(p, len(cuts)):
            if most_shared(last[p], last[q], most[p], most[q], run) < needed(low[p], low[q], percent) or 100 * high[p] < percent * low[q] or 100 * high[q] < percent * low[p]:
                continue
            b = cuts[q]
            i, j = np.meshgrid(np.arange(a, min(a + block, len(n))), np.arange(b, min(b + block, len(n))), indexing="ij")
            ok = (i < j) & (most_shared(pos[i], pos[j], left[i], left[j], run) >= needed(n[i], n[j], percent)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            out_i.append(i[ok])
            out_j.append(j[ok])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_i, out_j))
    return order[i], order[j]


_PAIR = "x long, y long, nx int, ny int, star boolean"
_PAIR_ARROW = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("nx", pa.int32()), ("ny", pa.int32()), ("star", pa.bool_())])


def _listed(percent: int, hub_list: int = HUB_LIST):
    """The index lists of a bucket: candidate pairs, each once."""

    long, run = min(LONG_LIST, hub_list), run_length(percent)

    def pairs(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        out = []
        for row in table.to_pylist():
            for held, c, kind in zip(parts, ("a", "b", "n", "pos"), (np.int64, np.uint32, np.int32, np.int32), strict=True):
                held.append(_unplanes(row[c], kind))
        if parts[0]:
            fp, token, n, pos = (np.concatenate(x) for x in parts)
            order = np.lexsort((pos, fp, n, token))
            fp, token, n, pos = fp[order], token[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            one = runs(token, fp, pos)  # a set that several tasks saw
            fp, token, n, pos = fp[one], token[one], n[one], pos[one]
            head = runs(token)
            length = np.diff(np.append(head, len(token)))
            if (length >= hub_list).any():  # a list's first set is the hub of the others, wherever tasks saw them
                hub = np.repeat(np.minimum.reduceat(fp, head), length)
                star = np.repeat(length >= hub_list, length) & (fp != hub)
                x, r = fp[star], hub[star]
                order = np.lexsort((r, x))
                one = order[runs(x[order], r[order])]
                x, r = x[one], r[one]
                out.append(pa.table([pa.array(x), pa.array(r), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int32()), pa.array(np.ones(len(x), bool))], schema=_PAIR_ARROW))
            xs, ys = [], []
            middle = (length >= long) & (length < hub_list)
            for h, m in zip(head[middle].tolist(), length[middle].tolist(), strict=True):
                i, j = list_pairs(n[h:h + m], pos[h:h + m], percent, run=run)
                xs.append(h + i)
                ys.append(h + j)
            # Short lists side by side: entry i with entry i + k of its list, as long as any size fits.
            end = np.repeat(head + length, length)
            i = np.flatnonzero(np.repeat((length >= 2) & (length < long), length))
            k = 1
            while len(i):
                i = i[(i + k) < end[i]]
                i = i[100 * n[i] >= percent * n[i + k]] if len(i) else i  # sorted by size: later ones are larger still
                j = i + k
                ok = most_shared(pos[i], pos[j], n[i] - pos[i], n[j] - pos[j], run) >= needed(n[i], n[j], percent)
                xs.append(i[ok])
                ys.append(j[ok])
                k += 1
            i, j = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
            other = fp[i] != fp[j]
            i, j = i[other], j[other]
            swap = fp[i] > fp[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                order = np.lexsort((fp[j], fp[i]))
                i, j = i[order], j[order]
                one = runs(fp[i], fp[j])
                i, j = i[one], j[one]
                out.append(pa.table([pa.array(fp[i]), pa.array(fp[j]), pa.array(n[i].astype(np.int32)), pa.array(n[j].astype(np.int32)), pa.array(np.zeros(len(i), bool))], schema=_PAIR_ARROW))
        return pa.concat_tables(out) if out else _PAIR_ARROW.empty_table()

    return pairs


_NEAR_ARROW = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("d", pa.int32())])


def _near(percent: int):
    """Pairs whose sketches don't rule a link out, and how far the sketches are apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = [batch.column(c).to_numpy().astype(np.int64) for c in ("nx", "ny")]
            d = apart(*(batch.column(c).to_pylist() for c in ("sx", "sy")))
            ok = d <= n[0] + n[1] - 2 * needed(n[0], n[1], percent)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(ok)), batch.column("y").filter(pa.array(ok)), pa.array(d[ok].astype(np.int32))], schema=_NEAR_ARROW)

    return task


_SET_ARROW = pa.schema([("fp", pa.int64()), ("items", pa.binary())])


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit map of 2^FILTER_BITS bits with two bits set for each ``k``: bounded, whatever the table's size."""
    mask = (1 << FILTER_BITS) - 1
    bit = keys.select(F.explode(F.array(F.expr(f"k & {mask}L"), F.expr(f"shiftrightunsigned(k, {FILTER_BITS}) & {mask}L"))).alias("p"))
    words = bit.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _hits(k: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold: all that it was made of, and a few more."""
    k, mask, use = k.view(np.uint64), np.uint64((1 << FILTER_BITS) - 1), np.ones(len(k), bool)
    for p in (k & mask, (k >> np.uint64(FILTER_BITS)) & mask):
        use &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return use


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in ``gone`` (doc_id: long); null ids stay.

    Rows that a filter of the ids rules out stay where they are; the others alone, with their texts, are shuffled for the join.
    """
    gone = written(gone.select("doc_id").distinct(), "join-gone")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(gone.select(F.xxhash64("doc_id").alias("k"))))

    @F.pandas_udf("boolean")
    def asked(keys: pd.Series) -> pd.Series:
        return pd.Series(_hits(keys.to_numpy(), shared.value))

    asked_for = asked(F.xxhash64(F.col(id_col).cast("long")))
    maybe = docs.where(asked_for)
    return docs.where(~asked_for).unionAll(maybe.join(gone, maybe[id_col] == gone["doc_id"], "left_anti"))


def _sets(shingle: int, shared):
    """Sets of the rows whose key may be asked for; a few more may come, which changes no answer."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = _hits(batch.column("k").to_numpy(), shared.value)
            data, offsets = string_parts(batch.column("text").filter(pa.array(use)))
            for a, b in slices(offsets):
                value, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle)
                edge = np.append(0, np.cumsum(counts))
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(value, counts)), pa.array([value[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], schema=_SET_ARROW)

    return task


_CHECKED = "x long, y long, star boolean, linked boolean, size int, less binary, more binary"
_CHECKED_ARROW = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("star", pa.bool_()), ("linked", pa.bool_()), ("size", pa.int32()), ("less", pa.binary()), ("more", pa.binary())])


def _checked(percent: int):
    """Exact intersections. For a pair of a set and its hub also the difference: places of the hub's shingles
    that the set doesn't have, and the set's own that the hub doesn't have."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, star, ix, iy in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "star", "ix", "iy")), strict=True):
                a, b = np.frombuffer(ix, np.uint64), np.frombuffer(iy, np.uint64)
                at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                hit = b[at] == a if len(b) else np.zeros(len(a), bool)
                both = int(hit.sum())
                less = more = None
                if star:
                    missing = np.ones(len(b), bool)
                    missing[at[hit]] = False
                    less, more = np.flatnonzero(missing).astype(np.int32).tobytes(), a[~hit].tobytes()
                rows.append((x, y, star, 100 * both >= percent * (len(a) + len(b) - both), len(b), less, more))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _CHECKED_ARROW, strict=True)], schema=_CHECKED_ARROW)

    return task


def check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair (x, y, star) with its exact answer. The pairs are written first: few of them are sent to the sets."""
    pairs = written(pairs, "join-asked-pairs")
    # Where the pairs are few, only the sets they name leave their scan.
    side = lambda name, items: sets.select(F.col("fp").alias(name), F.col("items").alias(items)).join(pairs.select(name), name, "left_semi")
    whole = pairs.join(side("x", "ix"), "x").join(side("y", "iy"), "y")
    return written(whole.select("x", "y", "star", "ix", "iy").mapInArrow(_checked(percent), _CHECKED), "checked")


_LINK = "x long, y long"
_LINK_ARROW = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def overlaps(size: int, less: list[np.ndarray], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, intersections of all pairs) of sets given by their differences to one set of ``size``."""
    n_less, n_more = np.array([len(v) for v in less]), np.array([len(v) for v in more])
    both = (size - n_less[:, None] - n_less[None, :]).astype(np.int64)
    for parts, counts in ((less, n_less), (more, n_more)):
        flat, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), counts)
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        keep = often[column] > 1  # an item of one set alone meets nothing
        row, column = row[keep], column[keep]
        _, column = np.unique(column, return_inverse=True)
        width = int(column.max()) + 1 if len(column) else 0
        for a in range(0, width, 4096):  # so that the matrix stays small
            m = np.zeros((len(parts), min(4096, width - a)), np.float32)
            some = (column >= a) & (column < a + 4096)
            m[row[some], column[some] - a] = 1
            both += np.rint(m @ m.T).astype(np.int64)
    np.fill_diagonal(both, size - n_less + n_more)
    return size - n_less + n_more, both


def linked(n: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Which of all pairs link."""
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def spanning(link: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hang the same labels together as all of ``link`` (symmetric): fewer than there are labels."""
    _, at = np.unique(label, return_inverse=True)
    seen, out = np.zeros(len(label), bool), [np.empty((2, 0), np.int64)]
    for root in np.unique(at[link.any(axis=1)]).tolist():
        if seen[root]:
            continue
        seen[root], front = True, np.flatnonzero(at == root)
        while len(front):
            j = np.flatnonzero(link[front].any(axis=0) & ~seen[at])
            j = j[np.unique(at[j], return_index=True)[1]]
            if len(j):
                out.append(np.stack([front[link[np.ix_(front, j)].argmax(axis=0)], j]))
            seen[at[j]] = True
            front = np.flatnonzero(np.isin(at, at[j]))
    i, j = np.concatenate(out, axis=1)
    return i, j


def _differences(table: pa.Table) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    return int(table.column("size")[0].as_py()), [np.frombuffer(v, np.int32) for v in table.column("less").to_pylist()], [np.frombuffer(v, np.uint64) for v in table.column("more").to_pylist()]


def _derived(percent: int):
    """A cell of a hub's sets: a spanning forest of the links of sets that don't hang together with the hub, from the differences to it."""

    def one(table: pa.Table) -> pa.Table:
        x = table.column("x").to_numpy()
        label, own = table.column("label").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        link = linked(*overlaps(*_differences(table)), percent) & (own[:, None] | own[None, :]) & (label[:, None] != label[None, :])
        i, j = spanning(link, label)
        return pa.table([pa.array(x[i]), pa.array(x[j])], schema=_LINK_ARROW)

    return one


_COUNT_ARROW = pa.schema([("x", pa.int64()), ("links", pa.int64())])


def _link_counts(percent: int):
    """For the sets of a cell, how many documents of other sets of their component link with them in this cell."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("label")
        label = table.column("label").to_numpy()
        out_x, out_n = [], []
        cut = np.append(runs(label), len(label))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            part = part.take(pa.array(np.unique(part.column("x").to_numpy(), return_index=True)[1]))  # a set may come twice
            x, copies, mine = (part.column(c).to_numpy() for c in ("x", "copies", "mine"))
            link = linked(*overlaps(*_differences(part)), percent) & (x[:, None] != x[None, :])
            if part.column("i")[0].as_py() != part.column("j")[0].as_py():
                link &= mine[:, None] != mine[None, :]
            out_x.append(x)
            out_n.append(link @ copies)
        return pa.table([pa.array(np.concatenate(out_x)), pa.array(np.concatenate(out_n))], schema=_COUNT_ARROW)

    return one


def count_links(nodes: DataFrame, sets: DataFrame, stars: DataFrame, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """x, links: how many documents of other sets link with each set that has a link.

    ``nodes``: fp, label, copies; ``stars``: checked pairs with hubs. A component of two sets has the one link that joined it. In a
    larger one every set is compared with one set, the hub that most of them were compared with already, and the answers of all pairs are derived from those differences, in cells of two
    blocks of about ``cell`` sets; cells hand on a number for each of their sets, never a pair. Small components share a task.
    """
    size = nodes.groupBy("label").agg(F.count("*").alias("m"), F.min("fp").alias("least")).where("m > 1")
    known = stars.select("x", "y").join(nodes.select(F.col("fp").alias("x"), "label"), "x").groupBy("label", "y").agg(F.count("*").alias("n"))
    hubs = known.groupBy("label").agg(F.max(F.struct("n", "y")).alias("h")).select("label", F.col("h.y").alias("y"))
    named = size.join(hubs, "label", "left").select("label", "m", F.coalesce("y", "least").alias("hub"))
    inside = written(nodes.join(named, "label"), "join-count-nodes")
    pair = inside.where("m = 2").select("label", "fp", "copies")
    other = pair.groupBy("label").agg(F.sum("copies").alias("all"))
    two = pair.join(other, "label").select(F.col("fp").alias("x"), (F.col("all") - F.col("copies")).alias("links"))
    more = inside.where("m > 2")
    wanted = more.select(F.col("fp").alias("x"), F.col("hub").alias("y"))
    had = stars.join(wanted, ["x", "y"], "left_semi").select("x", "size", "less", "more")
    new = check_pairs(wanted.join(stars.select("x", "y"), ["x", "y"], "left_anti").select("x", "y", F.lit(True).alias("star")), sets, percent)
    checked = had.unionAll(new.select("x", "size", "less", "more"))
    spread_over = max(1, -(-more.count() // (4 * cell)))
    rows = checked.join(more.select(F.col("fp").alias("x"), "label", "copies", F.ceil(F.col("m") / cell).cast("int").alias("u")), "x")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("x"), "u").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("u") - 1)))
    key = F.when(F.col("u") == 1, F.pmod(F.xxhash64("label"), F.lit(spread_over))).otherwise(F.col("label"))
    cells = rows.select("x", "label", "copies", "size", "less", "more", "mine", (F.col("u") == 1).alias("small"), key.alias("key"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    counted = cells.groupBy("small", "key", "i", "j").applyInArrow(_link_counts(percent), "x long, links long")
    return two.unionAll(counted.groupBy("x").agg(F.sum("links").alias("links")))


def derive_links(stars: DataFrame, labels: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links between a hub's sets that are in different components so far; ``stars``: checked pairs with hubs."""
    named = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
    hubs = labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
    rows = stars.select("x", "y").join(named, "x", "left").join(hubs, "y", "left").select("x", "y", F.coalesce("lx", "x").alias("label"), F.coalesce("ly", "y").alias("hub_label"))
    rows = written(rows.select("x", "y", "label", (F.col("label") != F.col("hub_label")).alias("own")), "hub-rows")
    count = rows.groupBy("y").agg(F.sum(F.col("own").cast("int")).alias("out"), F.count("*").alias("all")).where("out > 0")
    count = written(count.select("y", F.ceil(F.col("out") / block).cast("int").alias("u"), F.ceil((F.col("all") - F.col("out")) / block).cast("int").alias("l")), "hub-blocks")
    # A set outside the hub's component is in the cells of its block with every block; one inside, with every outside block.
    spot = lambda m: F.pmod(F.xxhash64("x"), m).cast("int")
    # The differences, which are wide, are fetched for hubs that have a set outside alone.
    open_hubs = rows.join(count, "y")
    dealt = stars.select("x", "y", "size", "less", "more").join(count.select("y"), "y", "left_semi").join(open_hubs, ["x", "y"]).select("x", "y", "size", "less", "more", "label", "own", "u", "l")
    seq = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    outside = dealt.where("own").withColumn("mine", spot(F.col("u")))
    uu = outside.withColumn("other", F.explode(seq(F.col("u")))).select("*", F.lit("uu").alias("kind"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    ul = outside.withColumn("other", F.explode(seq(F.col("l")))).select("*", F.lit("ul").alias("kind"), F.col("mine").alias("i"), F.col("other").alias("j"))
    inside = dealt.where("not own").withColumn("mine", spot(F.col("l")))
    lu = inside.withColumn("other", F.explode(seq(F.col("u")))).select("*", F.lit("ul").alias("kind"), F.col("other").alias("i"), F.col("mine").alias("j"))
    cells = uu.unionByName(ul).unionByName(lu).select("x", "y", "size", "less", "more", "label", "own", "kind", "i", "j")
    return cells.groupBy("y", "kind", "i", "j").applyInArrow(_derived(percent), _LINK)


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hot_sets: int = HOT_SETS, hot_list: int = HOT_LIST, block: int = BLOCK, flush_words: int = FLUSH_WORDS, count: bool = True, hub_list: int = HUB_LIST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node (the fingerprint of its set), n_links.

    ``n_links`` is the number of other documents that link with it, copies included; null if ``count`` is off.
    """
    with scratch(docs.sparkSession, ("join-survey", "join-members", "join-names", "join-links", "join-copies")):
        return _joined(docs, shingle, percent, id_col, text_col, hot_sets, hot_list, block, flush_words, count, hub_list)


def _joined(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, hot_sets: int, hot_list: int, block: int, flush_words: int, count: bool, hub_list: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(rows.mapInArrow(_surveyed(shingle, flush_words), _FIRST), "join-survey")
    members = first.where("not hot").select("doc_id", "fp", "n")
    row_id = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    nodes = first.where("not hot and n > 0").groupBy("fp").agg(F.max("sketch").alias("sketch"), F.min(row_id).alias("row"))
    often = first.where("hot").groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= hot_sets)
    hot = often.orderBy(F.desc("sets"), "token").limit(hot_list).toArrow()
    shared = spark.sparkContext.broadcast(HotList(*(hot.column(c).to_numpy().astype(np.int64) for c in ("token", "sets"))))

    buckets = min(8 * splits(rows), 1 << 20)
    index = rows.mapInArrow(_indexed(shingle, percent, buckets, flush_words, shared), _PACKED)
    found = written(index.groupBy("bucket").applyInArrow(_listed(percent, hub_list), _PAIR), "join-pairs")
    nodes = written(nodes, "join-nodes")

    plain = found.where("not star").select("x", "y", "nx", "ny").distinct()
    sx = plain.join(nodes.select(F.col("fp").alias("x"), F.col("sketch").alias("sx")), "x")
    near = written(sx.join(nodes.select(F.col("fp").alias("y"), F.col("sketch").alias("sy")), "y").mapInArrow(_near(percent), "x long, y long, d int"), "join-near")
    stars = written(found.where("star").select("x", "y").distinct(), "join-stars")

    # Sets of the nodes that are compared at all, from one row of each. The filter has a fixed size; where it
    # lets more rows through, more sets are written.
    wanted = near.select(F.explode(F.array("x", "y")).alias("fp")).unionAll(stars.select(F.explode(F.array("x", "y")).alias("fp"))).distinct()
    asked = nodes.join(wanted, "fp", "left_semi").select(F.when(~F.col("row.no_id"), F.col("row.id")).alias("doc_id"))
    chosen = spark.sparkContext.broadcast(key_filter(asked.select(F.xxhash64("doc_id").alias("k"))))
    sets = written(rows.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(_sets(shingle, chosen), "fp long, items binary"), "join-sets")

    # Each set with its most similar candidate, and with its hubs.
    both = near.unionAll(near.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
    best = both.groupBy("x").agg(F.min(F.struct("d", "y")).alias("b")).select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct()
    one = check_pairs(best.select("x", "y", F.lit(False).alias("star")).unionAll(stars.select("x", "y", F.lit(True).alias("star"))), sets, percent)
    links = one.where("linked").select("x", "y")
    labels = components(links)

    # Pairs that don't hang together yet.
    lx, ly = labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
    apart = near.join(lx, "x", "left").join(ly, "y", "left").where(F.coalesce("lx", "x") != F.coalesce("ly", "y")).select("x", "y")
    rest = apart.join(one.where("not star").select("x", "y"), ["x", "y"], "left_anti")
    two = check_pairs(rest.select("x", "y", F.lit(False).alias("star")), sets, percent)
    links = links.unionAll(two.where("linked").select("x", "y"))
    three = written(derive_links(one.where("star"), labels, percent, block), "join-derived")
    labels = components(links.unionAll(three))

    # The smallest id of each component.
    inside = members.where("n > 0").join(labels, members["fp"] == labels["node"], "left").select("doc_id", "n", "fp", F.coalesce("label", "fp").alias("label"))
    inside = written(inside, "join-members")
    names = written(inside.groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-names")
    if count:
        copies = written(inside.groupBy("fp", "label").agg(F.count("*").alias("copies")), "join-copies")
        others = written(count_links(copies, sets, one.where("star"), percent), "join-links").withColumnRenamed("x", "fp")
        known = copies.join(others, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        inside = inside.join(known, "fp")
    else:
        inside = inside.withColumn("n_links", F.lit(None).cast("long"))
    out = inside.join(names, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("fp").alias("node"), "n_links")
    return out.unionAll(members.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id"), F.lit(None).cast("long"), F.lit(0 if count else None).cast("long")))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components and numbers of links of the whole documents table by word 4-grams at 85 percent."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), h AS (
  SELECT doc_id, hash(g) AS g FROM s
), n AS (
  SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r(doc_id, o) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.y, r.o FROM r JOIN e ON e.x = r.doc_id WHERE r.o < e.y
), m AS (
  SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id
), k AS (
  SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
