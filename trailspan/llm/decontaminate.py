"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up, exact check.

Texts and items become words (runs of letters and digits in lower case; any byte over 127 counts
as a letter) and shingles of ``SHINGLE`` words (an item with fewer words is one shingle). A
shingle's weight is 1 + ln(items / items that have it); one that no item has weighs as much as one
that a single item has. Both are counted over the whole benchmark, in Spark.

For each length that items have, the windows of that many words of a text get a SimHash of their
weighted shingles; a text with fewer words than that is one window as a whole. Fingerprints are cut into ``BLOCKS`` blocks of 8 bits: two within ``RADIUS`` bits
differ by at most RADIUS // BLOCKS bits in some block, so a look-up of all block values that near
finds every item within the radius. Candidates are then compared exactly: sum of the smaller
weights over sum of the larger ones of both shingle multisets, which must reach ``SIMILARITY``.

A window can only reach that if it shares a shingle with the item, so only windows around a
shingle of some item are built. The items are a stated query set: they go through the driver in blocks
of ``ITEM_CHARS`` characters at most, each block against all rows. Each block has the counts of all
shingles that several items of the benchmark have, its own or not, since a window's other shingles weigh
too: 16 bytes each, at most half as many as the benchmark has words. So results don't depend on the blocks.

Defined cases: null or empty texts match nothing, nor do items without a word. Equal items match
alike, each under its id. Of several windows the most similar counts, then the first. Null ids are
kept in the result. Rows with equal ids are judged each on their own. An empty table of documents gives no row, an empty
benchmark no match. Texts are used whole; ``with_flag`` keeps other columns, but one of the flag's name goes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, rolling, slices, spread, string_parts

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 8
RADIUS = 23
#: Characters of items in one block of the query set, which is what the driver holds.
ITEM_CHARS = 8_000_000
_BASE = 0xA24BAED4963EE407
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_BITS = np.arange(64, dtype=np.uint64)
_WEIGHT_OF_BYTE = np.array([bin(x).count("1") for x in range(256)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    data, offsets = string_parts(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    words = Words(data, offsets, inside=_INSIDE)
    return words.hashes(), words.counts


def fingerprint(signs: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 weighted sums."""
    return ((signs > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def _votes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bit = (mixed(shingles)[:, None] >> _BITS) & np.uint64(1)
    return np.where(bit == 1, weights[:, None], -weights[:, None])


def _often(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are there several times, sorted, and how often."""
    found, times = np.unique(shingles, return_counts=True)
    return found[times > 1], times[times > 1]


class Items:
    """One block of the query set, ready for look-ups."""

    def __init__(self, names: list[int | None], texts: list[str | None], shingle: int, similarity: float, blocks: int, radius: int, all_items: int, frequency: tuple[np.ndarray, np.ndarray] | None = None):
        """``frequency``: the shingles that several of all items have, sorted, and how many have each; these items' own if None."""
        if 64 % blocks or 64 // blocks != 8:
            raise ValueError("blocks of 8 bits are looked up: 8 blocks")
        self.shingle, self.similarity, self.blocks, self.radius = shingle, similarity, blocks, radius
        hashes, counts = word_hashes(pa.array(texts, pa.large_string()))
        first = np.cumsum(counts) - counts
        self.names, self.lengths, self.bags = [], [], []
        for k, (a, n) in enumerate(zip(first, counts, strict=True)):
            if n:
                self.names.append(names[k])
                self.lengths.append(int(n))
                self.bags.append(Counter(rolling(hashes[a:a + n], min(shingle, int(n)), _BASE).tolist()))
        own = np.array([h for bag in self.bags for h in bag], np.uint64)
        self.known = np.unique(own)
        self.often, have = _often(own) if frequency is None else frequency
        self.top = 1.0 + math.log(max(1, all_items))
        self.weight = 1.0 + np.log(max(1, all_items) / have)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.groups = {}
        for n in sorted(set(self.lengths)):
            mine = [k for k, m in enumerate(self.lengths) if m == n]
            prints = np.array([self._print(self.bags[k]) for k in mine], np.uint64)
            # near[b, v]: items whose block b is within radius // blocks bits of value v
            value = np.arange(256)
            near = np.zeros((blocks, 256, len(mine)), bool)
            for b in range(blocks):
                own = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
                near[b] = _WEIGHT_OF_BYTE[value[:, None] ^ own[None, :]] <= radius // blocks
            self.groups[n] = (mine, prints, near)

    def weights_of(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.often, shingles), max(0, len(self.often) - 1))
        return np.where(self.often[at] == shingles, self.weight[at], self.top) if len(self.often) else np.full(len(shingles), self.top)

    def has(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        maybe = np.flatnonzero(self.seen[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == shingles[maybe]]

    def _print(self, bag: Counter) -> int:
        h = np.array(list(bag), np.uint64)
        return int(fingerprint(_votes(h, self.weights_of(h) * np.array(list(bag.values()), float)).sum(axis=0)[None, :])[0])

    def similar(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a window's shingles, exactly."""
        bag, other = self.bags[item], Counter(window.tolist())
        names = list(bag.keys() | other.keys())
        w = self.weights_of(np.array(names, np.uint64))
        a, b = np.array([bag[x] for x in names]), np.array([other[x] for x in names])
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def matches(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of each pair of a text and an item that is similar enough."""
        last = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(self.shingle, n) for n in self.groups}:
            rolled = rolling(words, size, _BASE)
            hits[size] = rolled, self.has(rolled)
        for n, (mine, prints, near) in self.groups.items():
            size = min(self.shingle, n)
            rolled, at = hits[size]
            if not len(at):
                continue
            row = np.searchsorted(last, at, "right")
            inside = at + size <= last[row]
            at, row = at[inside], row[inside]
            # Windows of n words that hold one of these shingles, inside the row.
            lo = np.maximum(at - (n - size), (last - counts)[row])
            hi = np.minimum(at, last[row] - n)
            ok = hi >= lo
            starts = np.unique(spread(lo[ok], (hi - lo + 1)[ok]))
            # A row with fewer words is one window as it is.
            short = np.unique(row[counts[row] < n])
            starts = np.concatenate([starts, (last - counts)[short]])
            shingles = np.append(np.full(len(starts) - len(short), n - size + 1), counts[short] - size + 1)
            for some in np.array_split(np.arange(len(starts)), max(1, len(starts) // 4096)):
                if not len(some):
                    continue
                part, per = starts[some], shingles[some]
                # Votes are summed once per place of the stretch and taken as differences.
                base = np.unique(spread(part, per))
                upto = np.zeros((len(base) + 1, 64))
                np.cumsum(_votes(rolled[base], self.weights_of(rolled[base])), axis=0, out=upto[1:])
                place = np.searchsorted(base, part)
                signs = upto[place + per] - upto[place]
                signs[np.abs(signs) < 1e-9] = 0.0
                print_ = fingerprint(signs)
                found = np.zeros((len(part), len(mine)), bool)
                for b in range(self.blocks):
                    found |= near[b][((print_ >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)]
                w, k = np.nonzero(found)
                close = np.bitwise_count(print_[w] ^ prints[k]) <= self.radius
                for i, m, j in zip(part[w[close]].tolist(), per[w[close]].tolist(), k[close].tolist(), strict=True):
                    item = mine[j]
                    s = self.similar(item, rolled[i:i + m])
                    if s >= self.similarity:
                        r = int(np.searchsorted(last, i, "right"))
                        first = i - int(last[r] - counts[r])
                        key = (r, item)
                        if key not in best or (s, -first) > (best[key][0], -best[key][1]):
                            best[key] = (s, first)
        for (r, item), (s, first) in best.items():
            yield r, item, s, first


_MATCH = "doc_id long, item_id long, similarity double, first_word long, n_words long"
_MATCH_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _searched(items: Items):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = string_parts(batch.column("text"))[1]
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                words, counts = word_hashes(part.column("text"))
                found = sorted(items.matches(words, counts))
                if found:
                    row, item, s, first = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array([items.names[i] for i in item], pa.int64()), pa.array(s, pa.float64()), pa.array(first, pa.int64()), pa.array([min(items.lengths[i], int(counts[r])) for r, i in zip(row, item, strict=True)], pa.int64())], schema=_MATCH_ARROW)

    return task


def _item_blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    """The query set in blocks of about ``most`` characters; one block at a time is in the driver."""
    names, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        names.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
        if size >= most:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


_COUNT_ARROW = pa.schema([("shingle", pa.int64()), ("items", pa.int64())])


def _item_shingles(shingle: int):
    """Shingles of items and how many of a slice's items have each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(string_parts(batch.column("text"))[1]):
                hashes, counts = word_hashes(batch.column("text").slice(a, b - a))
                first = np.cumsum(counts) - counts
                own = [np.unique(rolling(hashes[f:f + n], min(shingle, int(n)), _BASE)) for f, n in zip(first, counts, strict=True) if n]
                if own:
                    found, items = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(items)], schema=_COUNT_ARROW)

    return task


def item_frequency(benchmark: DataFrame, shingle: int = SHINGLE) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number of all items, and the shingles that several of them have with their counts, sorted by shingle."""
    counts = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(_item_shingles(shingle), "shingle long, items long")
    often = counts.groupBy("shingle").agg(F.sum("items").alias("items")).where("items > 1").toArrow()
    name, have = often.column("shingle").to_numpy().view(np.uint64), often.column("items").to_numpy()
    order = np.argsort(name)
    return benchmark.count(), (name[order], have[order])


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, blocks: int = BLOCKS, radius: int = RADIUS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each similar pair."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    all_items, frequency = item_frequency(benchmark, shingle)
    for names, texts in _item_blocks(benchmark, item_chars):
        items = Items(names, texts, shingle, similarity, blocks, radius, all_items, frequency)
        if items.names:
            part = rows.mapInArrow(_searched(items), _MATCH)
            out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], _MATCH)


def _flagger(items: Items):
    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        hit = np.zeros(len(column), bool)
        for a, b in slices(string_parts(column)[1]):
            for row, *_ in items.matches(*word_hashes(column.slice(a, b - a))):
                hit[a + row] = True
        return pd.Series(hit)

    return found


def with_flag(docs: DataFrame, benchmark: DataFrame, flag_col: str = "contaminated", shingle: int = SHINGLE, similarity: float = SIMILARITY, blocks: int = BLOCKS, radius: int = RADIUS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """docs with a boolean behind its own columns: whether the row's text has a passage of the benchmark.

    A narrow map: rows are judged where they are, so repeated and null ids need no join.
    """
    flag = F.lit(False)
    all_items, frequency = item_frequency(benchmark, shingle)
    for names, texts in _item_blocks(benchmark, item_chars):
        items = Items(names, texts, shingle, similarity, blocks, radius, all_items, frequency)
        if items.names:
            flag = flag | _flagger(items)(F.col("text").cast("string"))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != flag_col.lower()), flag.alias(flag_col))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, over whole texts."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
