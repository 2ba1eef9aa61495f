"""Collocations: frequent phrases by language, counted with double-array tries, scored by their weakest cut.

Texts are lower-cased (A to Z only), cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words
``[^\\x20\\x09]+``. A phrase is 2 to ``LONGEST`` words that follow each other in a piece; f(phrase) counts its
occurrences in a language, overlapping ones included, n all the words of the language.

* *Words.* One scan of the texts counts words and, in the same pass, writes each text as the hashes of its words. All later scans
  read hashes: no text is cut into words twice. The first of them leaves out words that a bit map (2 MB) shows not to be frequent,
  since no frequent phrase holds one, and counts every pair of neighbours in one of 2^``BUCKET_BITS`` hash buckets. A pair whose
  bucket stays below the threshold can't be frequent; the kept buckets are a bit map of fixed size (2 MB).
* *Candidates.* A phrase of k words is a candidate only if it occurs, its bucket is full, and both phrases of k - 1 words in it are
  frequent (Apriori), so no frequent phrase is missed. The scan that counts a level counts the buckets of the phrases that
  prolong its candidates by a word; the next scan sends the distinct phrases in full buckets that prolong a frequent one, and
  joins with the frequent phrases keep the safe ones. A bucket's phrases are announced by some ``ANNOUNCED_BY`` tasks at first, not by
  every task that has them; where a bucket still holds enough occurrences beyond those of the candidates counted so far, all
  tasks announce its phrases. So none is missed, and nothing is paired off within a group.
* *Counting.* Candidates are dealt out to blocks of about ``BLOCK`` phrases. A block becomes a double-array trie (the
  child of state s by symbol c is slot base[s] + c, if check[slot] is s; the first level is the language), which is
  broadcast: its size is bounded by ``BLOCK``, whatever the table. Tasks move all text positions through the trie
  at once, a level at a time, count the accepting states with ``bincount``, and Spark sums the counts of all tasks.
  With more candidates than a block holds, blocks follow each other, a scan each.
* *Scores.* Cutting a phrase after its first k words gives floor(1000 * a * n / (l * r)), in decimals of 38 digits;
  the cut with the lowest score counts, the smallest k among equals.
* A phrase goes if a longer candidate that contains it occurs as often. Containment is an equi-join on the
  sub-phrases of candidates, at most nine for each.

Words are counted by their text; in phrases they are told apart by hashes of 63 bits, and frequent phrases get their
text from the frequent phrase they prolong and the word it is prolonged by.

Defined cases: null text counts as empty, null language as ``und``. Repeated rows count each time they occur. An
empty table gives no row. Equal scores are ordered by f, descending, then by the phrase's bytes. Texts are used
whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, batches_of, mixed, runs, scratch, slices, splits, spread, string_parts, written

LONGEST = 5
AT_LEAST = 100
#: Rows of the result for each language: the report's length.
TOP = 2000
BUCKET_BITS = 24
#: Tasks that announce a candidate at first, about.
ANNOUNCED_BY = 4
#: Candidates of one trie.
BLOCK = 400_000
#: Distinct rows that a task holds before it sends them.
HELD = 400_000
#: Bytes of rows that go to a Python worker at a time; else a task's whole rows are a batch, in the JVM and in the worker.
BATCH_BYTES = 2 << 20
NO_LANGUAGE = "und"

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09]] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE[_BREAK] = False
_NEXT = np.uint64(0x9E6C63D0876A9A35)


class Pieces(Words):
    """The words of some rows, and how many words of its piece are left at each (itself included)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, lower=True, inside=_INSIDE)
        n = len(self.starts)
        self.hash = self.hashes()
        self.row = self.rows()
        breaks = np.append(0, np.cumsum(_BREAK[data]))
        last = np.ones(n, bool)
        if n > 1:
            last[:-1] = (self.row[1:] != self.row[:-1]) | (breaks[self.starts[1:]] != breaks[self.ends[:-1]])
        where = np.flatnonzero(last)
        self.left = where[np.searchsorted(where, np.arange(n))] - np.arange(n) + 1 if n else np.empty(0, np.int64)

    def texts(self, at: np.ndarray) -> pa.Array:
        """The text of these words."""
        size = self.ends[at] - self.starts[at]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[spread(self.starts[at], size)])])


#: The bit of a code that isn't the word's: whether a word of the same piece follows.
_MORE = np.uint64(1)


class Codes:
    """What ``Pieces`` says of the words of some rows, from their codes: hash, row and words left."""

    def __init__(self, codes: np.ndarray, row: np.ndarray):
        self.codes, self.hash, self.row, self.more = codes, codes & ~_MORE, row, (codes & _MORE).astype(bool)
        last = np.flatnonzero(~self.more)
        self.left = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(codes)) + 1

    @classmethod
    def of(cls, hashes: np.ndarray, row: np.ndarray, more: np.ndarray) -> Codes:
        """Words that have a neighbour; ``more``: the next word follows in the same piece."""
        linked = more.copy()
        linked[1:] |= more[:-1]
        at = np.flatnonzero(linked)
        return cls((hashes[at] & ~_MORE) | more[at].astype(np.uint64), row[at])

    def often(self, bit_map: np.ndarray, bits: int) -> Codes:
        """Without the words that the bit map doesn't know: pieces are cut there."""
        known = _in(bit_map, self.hash >> np.uint64(64 - bits))
        more = self.more & known
        more[:-1] &= known[1:]
        return Codes.of(self.hash, self.row, more)


def _cells(codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells of so many codes each."""
    offsets = np.append(0, np.cumsum(counts * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])


def _codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) of binary cells."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) // 8
    return np.frombuffer(data, np.uint64, at[-1])[at[0]:], at - at[0]


def _in(bit_map: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bit_map[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Buckets:
    """Numbers by bucket in 16 bits; a bucket with more counts as one with ``MANY``, so it is never taken for explained."""

    MANY = 1 << 40

    def __init__(self, bits: int):
        self.shift, self.most, self.n = np.uint64(64 - bits), (1 << 16) - 1, np.zeros(1 << bits, np.uint16)

    def add(self, keys: np.ndarray) -> None:
        at, n = np.unique((keys >> self.shift).astype(np.int64), return_counts=True)
        self.n[at] = np.minimum(self.n[at] + n, self.most)

    def full(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets with a number, numbers), a stretch of buckets at a time."""
        for a in range(0, len(self.n), 1 << 18):
            at = np.flatnonzero(self.n[a:a + (1 << 18)]) + a
            if len(at):
                yield at, np.where(self.n[at] == self.most, self.MANY, self.n[at].astype(np.int64))


def _announced(keys: np.ndarray, kept: np.ndarray, bits: int, part: int, share: int) -> np.ndarray:
    """Which keys lie in kept buckets that it's up to this task to announce."""
    bucket = keys >> np.uint64(64 - bits)
    mine = (bucket + np.uint64(part)) % np.uint64(share) == 0
    return mine & _in(kept, bucket)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Pieces]]:
    """(languages of the rows, their words) for each slice of text."""
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        for a, b in slices(string_parts(texts)[1]):
            pieces = Pieces(*string_parts(texts.slice(a, b - a)))
            if len(pieces.starts):
                yield langs.slice(a, b - a), pieces


def _read(batches: Iterator[pa.RecordBatch], numbers: list[int] | None = None) -> Iterator[tuple[pa.Array, Codes]]:
    """(languages of the rows, their words) for each slice of coded texts; the task's number goes into ``numbers``."""
    for batch in batches:
        if numbers is not None and batch.num_rows:
            numbers[0] = batch.column("part")[0].as_py()
        langs, (codes, offsets) = batch.column("lang"), _codes(batch.column("codes"))
        for a, b in slices(offsets * 8):
            yield langs.slice(a, b - a), Codes(codes[offsets[a]:offsets[b]], np.repeat(np.arange(b - a), np.diff(offsets[a:b + 1])))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash for each row's language."""
    coded = langs.dictionary_encode()
    known = np.array([mixed(Words(*string_parts(pa.array([f"{x}\x00"]))).hashes())[0] for x in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def _batch(schema: pa.Schema, **known) -> pa.RecordBatch:
    """Rows of a schema; the other columns are null."""
    n = len(next(iter(known.values())))
    return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)


def _coded(schema: pa.Schema, langs: pa.Array, codes: Codes) -> Iterator[pa.RecordBatch]:
    """A row of lang and codes for each row that has words."""
    head = runs(codes.row)
    if len(head):
        counts = np.diff(np.append(head, len(codes.row)))
        yield _batch(schema, lang=langs.take(pa.array(codes.row[head])).cast(pa.string()), codes=_cells(codes.codes, counts))


_SURVEY = "lang string, word string, code binary, bucket int, n long, codes binary"
_SURVEY_ARROW = pa.schema([("lang", pa.string()), ("word", pa.string()), ("code", pa.binary()), ("bucket", pa.int32()), ("n", pa.int64()), ("codes", pa.binary())])


def _survey(bits: int):
    """Words with their code, bucket and number, equal ones of a task summed first; and each text's codes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in table.to_batches(max_chunksize=20_000):
                code = Words(*string_parts(b.column("word"))).hashes() & ~_MORE
                bucket = pa.array((code >> np.uint64(64 - bits)).astype(np.int32))
                yield _batch(_SURVEY_ARROW, lang=b.column("lang"), word=b.column("word"), code=_cells(code, np.ones(len(code), np.int64)), bucket=bucket, n=b.column("n_sum"))

        for langs, words in _pieces(batches):
            yield from _coded(_SURVEY_ARROW, langs, Codes.of(words.hash, words.row, words.left > 1))
            _, at, n = np.unique(mixed(words.hash ^ _lang_hashes(langs)[words.row]), return_index=True, return_counts=True)
            held.append(pa.table({"lang": langs.take(pa.array(words.row[at])), "word": words.texts(at), "n": pa.array(n)}))
            size += len(at)
            if size > HELD:
                merged = summed()
                if len(merged) > HELD // 2:
                    yield from sent(merged)
                    held, size = [], 0
                else:
                    held, size = [merged.rename_columns({"n_sum": "n"})], len(merged)
        if held:
            yield from sent(summed())

    return task


_OFTEN = "lang string, codes binary, bucket int, n long"
_OFTEN_ARROW = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("bucket", pa.int32()), ("n", pa.int64())])


def _often(known: np.ndarray, bits: int):
    """Codes of texts without words that the bit map doesn't know, and bucket numbers of pairs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits)
        for langs, words in _read(batches):
            words = words.often(known, bits)
            buckets.add(_keys(langs, words, np.flatnonzero(words.left > 1), 2))
            yield from _coded(_OFTEN_ARROW, langs, words)
        for full, numbers in buckets.full():
            yield _batch(_OFTEN_ARROW, bucket=pa.array(full, pa.int32()), n=pa.array(numbers))

    return task


_COUNTS = "id long, bucket int, n long"
_COUNTS_ARROW = pa.schema([("id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])
_PHRASE = "lang string, code binary, bucket int"
_PHRASE_ARROW = pa.schema([("lang", pa.string()), ("code", pa.binary()), ("bucket", pa.int32())])


def _numbers(column: str, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a key (``id`` or ``bucket``) and its number."""
    for a in range(0, len(keys), 100_000):
        part = slice(a, a + 100_000)
        yield _batch(_COUNTS_ARROW, **{column: pa.array(keys[part]).cast(_COUNTS_ARROW.field(column).type), "n": pa.array(n[part], pa.int64())})


class _Seen:
    """Keys that a task has sent already; forgotten when they are many, since Spark makes rows distinct anyway."""

    def __init__(self, most: int = 4 * HELD):
        self.keys, self.most = np.empty(0, np.uint64), most

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that weren't seen, one for each."""
        keys, at = np.unique(keys, return_index=True)
        if len(self.keys):
            fresh = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
            keys, at = keys[fresh], at[fresh]
        base = self.keys if len(self.keys) + len(keys) <= self.most else self.keys[:0]
        self.keys = np.union1d(base, keys)
        return at


def _keys(langs: pa.Array, words: Codes, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the language and the phrase at each of these words, the same in all tasks."""
    key = _lang_hashes(langs)[words.row[at]]
    for j in range(size):
        key = mixed(key * _NEXT + words.hash[at + j])
    return key


def _named(langs: pa.Array, words: Codes, at: np.ndarray, size: int, keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    for a in range(0, len(at), 20_000):
        part = at[a:a + 20_000]
        code = _cells(np.stack([words.hash[part + j] for j in range(size)], axis=1), np.full(len(part), size))
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.row[part])).cast(pa.string()), code, pa.array(bucket[a:a + 20_000])], schema=_PHRASE_ARROW)


def _pairs(kept: np.ndarray, bits: int, share: int):
    """The distinct pairs of neighbours in kept buckets, as far as they are this task's to announce."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = _Seen(), [0]
        for langs, words in _read(batches, number):
            at = np.flatnonzero(words.left > 1)
            keys = _keys(langs, words, at, 2)
            mine = _announced(keys, kept, bits, number[0], share)
            at, keys = at[mine], keys[mine]
            new = seen.new(keys)
            yield from _named(langs, words, at[new], 2, keys[new], bits)

    return task


class DoubleArray:
    """A trie of phrases of one length; the first level is the language.

    ``base[s] + c`` is the slot of the child of state s by symbol c, if ``check`` of that slot is s. Symbol 0, 1, ...
    of a word is its place among the sorted hashes of the phrases' words. ``ids`` names the phrase of an
    accepting slot, -1 elsewhere.
    """

    def __init__(self, langs: list[str], hashes: np.ndarray, ids: np.ndarray):
        """``hashes``: a row for each phrase, its words' hashes; ``ids``: its number."""
        names = sorted(set(langs))
        self.slot_of = {x: k + 1 for k, x in enumerate(names)}
        self.size = hashes.shape[1]
        self.words = np.unique(hashes)
        bits = len(self.words).bit_length() + 1
        self._shift = np.uint64(64 - bits)
        self._first = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)
        symbols = np.searchsorted(self.words, hashes).astype(np.int64)
        parent = np.array([self.slot_of[x] for x in langs], np.int64)
        self._limit = 1 + len(names)
        room = max(1024, 4 * (symbols.size + len(names)))
        self.base, self.check = np.full(room, -(1 << 40), np.int64), np.full(room, -1, np.int64)
        self.base[0], self.check[1:self._limit] = 1, 0
        self._random = np.random.default_rng(7)
        order = np.lexsort([*symbols.T[::-1], parent]) if len(ids) else np.empty(0, np.int64)
        symbols, parent, ids = symbols[order], parent[order], ids[order]
        for j in range(self.size):
            head = runs(parent, symbols[:, j])
            child = self._place(parent[head], symbols[head, j])
            parent = np.repeat(child, np.diff(np.append(head, len(parent))))
        self.base, self.check = self.base[:self._limit].copy(), self.check[:self._limit].copy()
        self.ids = np.full(self._limit, -1, np.int64)
        self.ids[parent] = ids

    def _grow(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto - len(self.check), len(self.check) // 2)
            self.base = np.append(self.base, np.full(more, -(1 << 40), np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
        self._limit = max(self._limit, upto)

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots of children, given sorted by parent: those of large families first, single ones into what is free."""
        out = np.empty(len(parents), np.int64)
        head = runs(parents)
        count = np.diff(np.append(head, len(parents)))
        for f in np.argsort(-count, kind="stable"):
            n = int(count[f])
            if n == 1:
                break
            a, mine = int(head[f]), int(parents[head[f]])
            family = symbols[a:a + n]
            base = self._room(family)
            slots = base + family
            self._grow(int(slots[-1]) + 1)
            self.base[mine], self.check[slots] = base, mine
            out[a:a + n] = slots
        single = head[count == 1]
        if len(single):
            free = np.flatnonzero(self.check[1:self._limit] < 0)[:len(single)] + 1
            if len(free) < len(single):
                free = np.append(free, np.arange(self._limit, self._limit + len(single) - len(free)))
                self._grow(int(free[-1]) + 1)
            self.base[parents[single]], self.check[free] = free - symbols[single], parents[single]
            out[single] = free
        return out

    def _room(self, family: np.ndarray) -> int:
        """A base with which every child's slot is free; behind the last slot if some tries find none."""
        shift = family - family[0]
        for _ in range(4):
            first = self._random.integers(1, self._limit + 1, 64)
            first = first[self.check[np.minimum(first, len(self.check) - 1)] < 0]
            slots = first[:, None] + shift[None, :]
            taken = (slots < self._limit) & (self.check[np.minimum(slots, len(self.check) - 1)] >= 0)
            good = np.flatnonzero(~taken.any(axis=1))
            if len(good):
                return int(first[good[0]] - family[0])
        return int(self._limit - family[0])

    def _symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words among the trie's, -1 for others: first that of the least word with the same leading bits."""
        last = len(self.words) - 1
        symbol = np.minimum(self._first[(hashes >> self._shift).astype(np.int64)], last).astype(np.int64)
        behind = np.flatnonzero(self.words[symbol] < hashes)
        while len(behind):
            behind = behind[symbol[behind] < last]
            symbol[behind] += 1
            behind = behind[self.words[symbol[behind]] < hashes[behind]]
        return np.where(self.words[symbol] == hashes, symbol, -1)

    def states(self, langs: pa.Array, words: Pieces | Codes) -> tuple[np.ndarray, np.ndarray]:
        """(words at which a phrase of the trie starts, its accepting state): all positions move a level at a time."""
        if not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        coded = langs.dictionary_encode()
        slot = np.array([self.slot_of.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)
        state = slot[coded.indices.to_numpy(zero_copy_only=False)][words.row]
        symbol = self._symbols(words.hash)
        at = np.flatnonzero((words.left >= self.size) & (state >= 0) & (symbol >= 0))
        state = state[at]
        for j in range(self.size):
            c = symbol[at + j]
            child = self.base[state] + c
            inside = (c >= 0) & (child > 0) & (child < len(self.check))
            child = np.where(inside, child, 0)
            ok = inside & (self.check[child] == state)
            at, state = at[ok], child[ok]
        return at, state


def _counted(block, longer: bool, bits: int):
    """Numbers of the trie's phrases and, if ``longer``, of the buckets of phrases that prolong one by a word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = block.value
        total, buckets = np.zeros(len(trie.check), np.int64), Buckets(bits if longer else 0)
        for langs, words in _read(batches):
            at, state = trie.states(langs, words)
            if not len(at):
                continue
            if len(at) * 8 > len(total):
                total += np.bincount(state, minlength=len(total))
            else:
                np.add.at(total, state, 1)
            if longer:
                first = at[words.left[at] > trie.size]
                buckets.add(_keys(langs, words, first, trie.size + 1))
        found = np.flatnonzero(total)
        yield from _numbers("id", trie.ids[found], total[found])
        for full, numbers in buckets.full():
            yield from _numbers("bucket", full, numbers)

    return task


def _following(block, kept: np.ndarray, whole: bool, bits: int, share: int):
    """The distinct phrases in kept buckets that prolong one of the trie's by a word, as far as they are this task's to announce.

    If the trie holds all frequent phrases (``whole``), the phrase that starts a word later has to be one of them too.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, seen, number = block.value, _Seen(), [0]
        for langs, words in _read(batches, number):
            at, _ = trie.states(langs, words)
            if not len(at):
                continue
            on = words.left[at] > trie.size
            if whole:
                on[:-1] &= at[1:] == at[:-1] + 1
                on[-1] = False
            first = at[on]
            keys = _keys(langs, words, first, trie.size + 1)
            mine = _announced(keys, kept, bits, number[0], share)
            first, keys = first[mine], keys[mine]
            new = seen.new(keys)
            yield from _named(langs, words, first[new], trie.size + 1, keys[new], bits)

    return task


def _full_buckets(numbers: DataFrame, at_least: int) -> DataFrame:
    """bucket, n of buckets with enough occurrences."""
    return numbers.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _bit_map(full: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, set for these buckets: 4 KB for each 32768 of them."""
    maps = full.groupBy(F.expr("bucket div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("bucket % 32768")).alias("bits"))
    out = np.zeros(max(1 << bits, 32768) // 8, np.uint8)
    for row in maps.toLocalIterator():
        out[row["part"] * 4096:(row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _without(side: str, size: int) -> Column:
    """The code of a phrase of ``size`` words without its last or its first word."""
    return F.expr(f"substring(code, {1 if side == 'last' else 9}, {8 * (size - 1)})")


def _safe(phrases: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """The distinct phrases of ``size`` words whose first and last size - 1 words are frequent."""
    cut = phrases.distinct().withColumns({"__a": _without("last", size), "__b": _without("first", size)})
    for side in ("__a", "__b"):
        cut = cut.join(frequent.select("lang", F.col("code").alias(side)), ["lang", side], "left_semi")
    return cut.select("lang", "code", "bucket")


def _with_text(phrases: DataFrame, shorter: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """lang, phrase (its text), code, f, id: the text of all words but the last, which is frequent too, and that of the last."""
    cut = phrases.withColumns({"__a": _without("last", size), "__b": F.expr(f"substring(code, {8 * size - 7}, 8)")})
    cut = cut.join(shorter.select("lang", F.col("code").alias("__a"), F.col("phrase").alias("__text")), ["lang", "__a"])
    cut = cut.join(words.select("lang", F.col("code").alias("__b"), F.col("phrase").alias("__word")), ["lang", "__b"])
    return cut.select("lang", F.concat_ws(" ", "__text", "__word").alias("phrase"), "code", "f", "id")


def _tries(spark: SparkSession, phrases: DataFrame, size: int, block: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast tries of blocks of the phrases (id, lang, code), and whether there is only one; destroyed when the next is asked for."""
    blocks = -(-phrases.count() // block)
    for k in range(blocks):
        mine = phrases.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast(DoubleArray(mine.column("lang").to_pylist(), _codes(mine.column("code"))[0].reshape(-1, size), mine.column("id").to_numpy()))
        yield shared, blocks == 1
        shared.destroy()


def _all_of(tables: list[DataFrame]) -> DataFrame:
    both = tables[0]
    for t in tables[1:]:
        both = both.unionAll(t)
    return both


def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", bits: int = BUCKET_BITS, block: int = BLOCK, announced_by: int = ANNOUNCED_BY) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f of every phrase of 1 to ``longest`` words with f >= at_least; lang, n), both written."""
    if at_least < 1 or longest < 2:
        raise ValueError("phrases have two words or more and occur at least once")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with scratch(spark, keep=("phrases-level", "phrases-langs", "phrases-often")):
        survey = written(texts.mapInArrow(_survey(bits), _SURVEY), "phrases-words")
        totals = survey.where("word is not null")
        sizes = written(totals.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-langs")
        level = words = written(totals.groupBy("lang", F.col("word").alias("phrase"), "code", "bucket").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least), "phrases-level")
        coded = survey.where("codes is not null").select("lang", "codes")
        often = written(coded.mapInArrow(_often(_bit_map(words, bits), bits), _OFTEN), "phrases-often")
    rows = often.where("codes is not null").select("lang", "codes", F.spark_partition_id().alias("part"))
    found = level.select("lang", "phrase", "f", F.lit(1).alias("size"))
    full = written(_full_buckets(often, at_least), "phrases-buckets")
    dealt = max(1, splits(rows) // announced_by)
    for size in range(2, longest + 1):
        scans, candidates, left = [], [], full
        for share in sorted({dealt, 1}, reverse=True):  # a few tasks announce; then all, where a bucket isn't explained yet
            kept = _bit_map(left, bits)
            if not kept.any():
                break
            if size == 2:
                said = [written(rows.mapInArrow(_pairs(kept, bits, share), _PHRASE), "phrases-said")]
            else:
                said = [written(rows.mapInArrow(_following(t, kept, whole, bits, share), _PHRASE), "phrases-said") for t, whole in _tries(spark, level, size - 1, block)]
            if not said:
                break
            new = _safe(_all_of(said), level, size)
            if candidates:
                new = new.join(candidates[0].select("lang", "code"), ["lang", "code"], "left_anti")
            new = written(new.withColumn("id", F.monotonically_increasing_id() * 2 + len(candidates)), "phrases-candidates")
            candidates.append(new)
            scans += [written(rows.mapInArrow(_counted(t, size < longest, bits), _COUNTS), "phrases-counts") for t, _ in _tries(spark, new, size, block)]
            if share > 1 and scans:
                counted = _all_of(scans).where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))  # a row of each candidate meets its bucket, not one of each task
                known = counted.join(new, "id").groupBy("bucket").agg(F.sum("n").alias("f"))
                left = full.join(known, "bucket", "left").where(F.col("n") - F.coalesce("f", F.lit(0)) >= at_least).select("bucket")
        if not scans:
            break
        both = _all_of(scans)
        counts = both.where("id is not null").groupBy("id").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least)
        level = written(_with_text(_all_of(candidates).join(counts, "id"), level, words, size), "phrases-level")
        found = found.unionAll(level.select("lang", "phrase", "f", F.lit(size).alias("size")))
        full = written(_full_buckets(both, at_least), "phrases-buckets")
    return found, sizes


def _parts(phrases: DataFrame) -> DataFrame:
    """A row for each cut: k, and the two parts."""
    words = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    return cut.withColumn("left_part", F.array_join(F.slice(words, 1, F.col("k")), " ")).withColumn("right_part", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))


def _contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, and the largest f of a longer phrase that contains it."""
    words = F.split("phrase", " ")
    spans = phrases.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    spans = spans.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    return spans.select("lang", F.array_join(F.slice(words, F.col("i"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))


def collocations(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, top: int | None = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language (all if None)."""
    with batches_of(docs.sparkSession, BATCH_BYTES), scratch(docs.sparkSession, keep=("phrases-level", "phrases-langs")):
        found, sizes = frequent_phrases(docs, at_least, longest, **options)
    phrases = found.where("size > 1")
    part = found.select("lang", "phrase", "f")
    cuts = _parts(phrases).join(part.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("f", "n", "l", "r")}
    cuts = cuts.select("lang", "phrase", "f", "l", "r", "n", "k", (F.lit(1000).cast("decimal(4,0)") * (wide["f"] * wide["n"]).cast("decimal(34,0)")).cast("decimal(38,0)").alias("over"), (wide["l"] * wide["r"]).cast("decimal(38,0)").alias("under"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    low = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", F.col("f").alias("a"), "n")).alias("low")).select("lang", "phrase", "low.*")
    kept = low.join(_contained(phrases), ["lang", "phrase"], "left").where("f_longer is null or 100 * f_longer < 100 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = kept.withColumn("rank", rank)
    if top is not None:
        out = out.where(F.col("rank") <= top)  # Spark cuts each task's rows to the limit before the shuffle
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM t
), g AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM p, range(1, 6) AS s(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang
), c AS (
  SELECT lang, phrase, f, size, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1
), s AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = c.lang
), m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, f, string_split(phrase, ' ') AS ws, size, unnest(range(2, size)) AS m FROM f WHERE size > 2
), o AS (
  SELECT lang, f, unnest([array_to_string(ws[j:j + m - 1], ' ') FOR j IN range(1, size - m + 2)]) AS phrase FROM i
), q AS (
  SELECT lang, phrase, max(f) AS longer FROM o GROUP BY ALL
), k AS (
  SELECT m.* FROM m LEFT JOIN q ON q.lang = m.lang AND q.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k QUALIFY rank <= 2000
"""
