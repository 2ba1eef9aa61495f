"""Token ids in directly addressable codes: any id is read without decoding a block.

A shard holds the ids of consecutive documents in the order of their ids. Each token id is cut
into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every id; a bit map says which
ids go on, and level 1 holds the next chunk of those alone, and so on. The place of an id in the
next level is the number of set bits before it, which a rank directory (one count for every
``RANK_STEP`` bits) gives in constant time.

One shard, all numbers little-endian (see ``Shard``): magic ``TDAC0001``; level count, document
count and id count as 64-bit integers; for each document its first id's place (one more at the
end); then for each level its length as a 64-bit integer, its chunks (one byte each), its bit map
(padded to 8 bits) and its rank directory (64-bit integers).

Shards are cells of a table that Spark writes, so they can be in any store. Documents are dealt
out by ranges of their ids; a shard ends at the first document with which it has
``SHARD_IDS`` ids, so the memory of a task doesn't grow with the table.

Defined cases: null text counts as empty, and gives the end id alone. A null document id sorts
first and comes back as null. Rows with equal ids all keep their own ids and places; among them
the order is that of their texts. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, scratch_path, slices, splits, spread, string_parts, tokenizer_file

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CHUNK = 8
RANK_STEP = 512
SHARD_IDS = 1 << 20
#: Words whose ids a process remembers; with more it starts anew, which changes no id.
REMEMBERED = 1_000_000
#: Parts of letters that are given to the tokenizer as one text.
JOINED = 256
#: Signs that are cut from the end of a piece; none of them ends a special token or starts a contraction.
_TAIL = ".,;:!?%&$#*()\"/-"
# A body ends with a letter that stays one letter in composed form and in lower case.
_PLAIN_END = "[A-Za-zÀ-ÖØ-öø-įıĲ-ž]$"
_MAGIC = b"TDAC0001"


class Shard:
    """Reads one shard; ``token(i)`` touches one chunk, one bit and one rank for each level."""

    def __init__(self, raw: bytes):
        if raw[:8] != _MAGIC:
            raise ValueError("not a token shard")
        self.levels_n, self.docs, self.ids = struct.unpack_from("<qqq", raw, 8)
        at = 32
        self.starts = np.frombuffer(raw, "<i8", self.docs + 1, at)
        at += 8 * (self.docs + 1)
        self.levels = []
        for _ in range(self.levels_n):
            n = struct.unpack_from("<q", raw, at)[0]
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            at += n
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += len(bits)
            rank = np.frombuffer(raw, "<i8", n // RANK_STEP + 1, at)
            at += 8 * len(rank)
            self.levels.append((chunks, bits, rank))

    @staticmethod
    def packed(ids: np.ndarray, lengths: np.ndarray) -> bytes:
        """The bytes of a shard with these ids; ``lengths``: how many belong to each document."""
        out, rest, levels = [], ids.astype(np.uint32), 0
        while levels == 0 or len(rest):
            more = rest >> np.uint32(CHUNK)
            on = more > 0
            bits = np.packbits(on, bitorder="little")
            before = np.append(0, np.cumsum(on, dtype=np.int64))
            out += [struct.pack("<q", len(rest)), (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), before[::RANK_STEP][:len(rest) // RANK_STEP + 1].astype("<i8").tobytes()]
            rest, levels = more[on], levels + 1
        starts = np.append(0, np.cumsum(lengths)).astype("<i8")
        return b"".join([_MAGIC, struct.pack("<qqq", levels, len(lengths), len(ids)), starts.tobytes(), *out])

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            first = block * RANK_STEP // 8
            whole = int(np.bitwise_count(bits[first:i >> 3]).sum())
            i = int(rank[block]) + whole + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, by level from the top."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            mine = chunks.astype(np.uint32)
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            mine[on] |= value << np.uint32(CHUNK)
            value = mine
        return value

    def document(self, d: int) -> np.ndarray:
        """The ids of one document, by random access."""
        return np.array([self.token(i) for i in range(self.starts[d], self.starts[d + 1])], np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The rules of word_bpe_49k.json on which cutting a text into words rests.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _by_words(path: str) -> bool:
    """Whether ids of a text are those of its words: whether the vocabulary has the rules that ``Encoder`` rests on."""
    rules = json.loads(_tokenizer(path).to_str())
    signs = [t["content"] for t in rules["added_tokens"]]
    return (
        rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and not rules["post_processor"]
        and all("<" in t and t.isascii() and not any(c.isspace() for c in t) and t[-1] not in _TAIL for t in signs)
    )


class Ids:
    """Ids by the 64-bit hash of what they encode."""

    def __init__(self):
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.first, self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keys that aren't known yet, ascending, with their ids one after the other."""
        at = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, at, np.arange(len(self.sizes), len(self.sizes) + len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)

    def of(self, slots: np.ndarray) -> np.ndarray:
        """The ids at these places, one after the other."""
        return self.ids[spread(self.first[slots], self.sizes[slots])]


class Encoder:
    """Ids of whole texts, by way of their distinct words.

    This vocabulary's tokens never cross white space, nor the border between a letter and the sign
    behind it, and ASCII letters count in lower case. So texts are cut at white space, and only words that a
    process hasn't met yet are looked at: they are cut into a body and the signs of ``_TAIL`` that end it, and each
    new part is encoded once. Parts with other signs, such as those of special tokens, are left as they are.
    Words and parts are remembered by a 64-bit hash. For a vocabulary with other rules texts are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer, self.most, self.by_words = _tokenizer(path), remembered, _by_words(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = Ids(), Ids()

    def _encoded_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, with parts of letters alone put together: each of them ends with a token that ends a word."""
        plain = np.fromiter((p.isalpha() and (p.isascii() or unicodedata.normalize("NFC", p).lower().isalpha()) for p in parts), bool, len(parts))
        named = np.flatnonzero(plain)
        ids, _ = self._encoded([" ".join([parts[k] for k in named[a:a + JOINED].tolist()]) for a in range(0, len(named), JOINED)])
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(named):  # not so in this case: each part by itself
            return self._encoded(parts)
        sizes = np.empty(len(parts), np.int64)
        other, sizes[~plain] = self._encoded([parts[k] for k in np.flatnonzero(~plain).tolist()])
        sizes[plain] = np.diff(np.append(-1, last))
        out = np.empty(int(sizes.sum()), np.uint32)
        mine = np.repeat(plain, sizes)
        out[mine], out[~mine] = ids, other
        return out, sizes

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _slots(self, parts: pa.Array) -> np.ndarray:
        """Place of each part, each a word or empty, among the known ones; unknown ones are encoded."""
        at = Words(*string_parts(parts))
        keys = np.zeros(len(parts), np.uint64)
        keys[at.rows()] = at.hashes()
        slots = self.parts.find(keys)
        if (slots < 0).any():
            new, one = np.unique(keys[slots < 0], return_index=True)
            texts = parts.take(pa.array(np.flatnonzero(slots < 0)[one])).to_pylist()
            self.parts.add(new, *self._encoded_parts(texts))
            slots = self.parts.find(keys)
        return slots

    def _learn(self, keys: np.ndarray, words: pa.Array) -> None:
        """Distinct new words, each from its body and its tail."""
        bare = pc.utf8_rtrim(words, characters=_TAIL)
        bare = pc.if_else(pc.match_substring_regex(bare, _PLAIN_END), bare, words)
        cut = pc.binary_length(bare).to_numpy()
        longer = np.flatnonzero(pc.binary_length(words).to_numpy() > cut)
        tails = np.full(len(words), None, object)
        tails[longer] = [w[n:] for w, n in zip(words.take(pa.array(longer)).cast(pa.large_binary()).to_pylist(), cut[longer].tolist(), strict=True)]
        body = self._slots(pc.if_else(pc.match_substring(bare, "<"), bare, pc.ascii_lower(bare)))
        tail = self._slots(pa.array(tails, pa.large_binary()).cast(pa.large_string()).fill_null(""))
        both = np.stack([body, tail], axis=1).ravel()
        self.words.add(keys, self.parts.of(both), self.parts.sizes[body] + self.parts.sizes[tail])

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each), with ``end`` behind each text."""
        if self.by_words:
            if len(self.words.keys) > self.most:
                self._forget()
            data, offsets = string_parts(texts)
            words = Words(data, offsets)
            keys = words.hashes()
            slots = self.words.find(keys)
            unknown = np.flatnonzero(slots < 0)
            if len(unknown):
                new, one = np.unique(keys[unknown], return_index=True)
                raw, at = data.tobytes(), unknown[one]
                self._learn(new, pa.array([raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)], pa.large_binary()).cast(pa.large_string()))
                slots[unknown] = self.words.find(keys[unknown])
            ids, per_word, first = self.words.of(slots), self.words.sizes[slots], words.first
        else:
            ids, per_word = self._encoded(texts.fill_null("").to_pylist())
            first = np.arange(len(texts) + 1)
        edge = np.append(0, np.cumsum(per_word))[first]
        lengths = np.diff(edge) + 1
        out = np.full(int(lengths.sum()), end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths) - 1] = False
        out[inside] = ids
        return out, lengths


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each process: what a task has learned serves the next."""
    return Encoder(path)


_SHARD = "part int, shard int, ids long, doc_ids array<long>, data binary"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])


def _shards(path: str, end: int, shard_ids: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, part = _encoder(path), 0, 0
        held, lengths, docs, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids, n = np.concatenate(held), np.concatenate(lengths)
            names = pa.concat_arrays(docs)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([Shard.packed(ids, n)], pa.binary())], schema=_SHARD_ARROW)

        for batch in batches:
            names, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            offsets = string_parts(texts)[1]
            for a, b in slices(offsets, 3 << 20):
                ids, n = encoder(texts.slice(a, b - a), end)
                at = np.append(0, np.cumsum(n))
                first = 0
                while first < len(n):  # a shard ends where it's full, wherever the batch ends
                    last = min(len(n), int(np.searchsorted(at, at[first] + shard_ids - size, "left")))
                    last = max(last, first + 1)
                    held.append(ids[at[first]:at[last]])
                    lengths.append(n[first:last])
                    docs.append(names.slice(a + first, last - first))
                    size += int(at[last] - at[first])
                    first = last
                    if size >= shard_ids:
                        yield shard()
                        held, lengths, docs, size, number = [], [], [], 0, number + 1
        if held:
            yield shard()

    return task


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END_ID, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write shards in ascending order of ids to ``folder`` (shards/ and parts/)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(max(2, 2 * splits(rows)), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_shards(tokenizer_file(vocabulary), end, shard_ids), _SHARD)
    shards.write.option("compression", "zstd").parquet(f"{folder}/shards")
    written = docs.sparkSession.read.schema(_SHARD).parquet(f"{folder}/shards")
    totals = written.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row per task: small at any size of the table
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("before")).write.parquet(f"{folder}/parts")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, shard, first (ids of all shards before it), ids."""
    shards = spark.read.schema(_SHARD).parquet(f"{folder}/shards").select("part", "shard", "ids")
    parts = spark.read.schema("part int, before long").parquet(f"{folder}/parts")
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("within", within).join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("first"), "ids")


_READ = "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long"
_READ_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32())] + [(c, pa.int64()) for c in ("doc_id", "place", "n_tokens", "ids_crc32")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard = Shard(batch.column("data")[row].as_buffer().to_pybytes())
            raw, at = memoryview(shard.all().astype("<u4").tobytes()), shard.starts
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            where = [pa.array(np.full(shard.docs, batch.column(c)[row].as_py(), np.int32)) for c in ("part", "shard")]
            yield pa.RecordBatch.from_arrays([*where, batch.column("doc_ids")[row].values, pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], schema=_READ_ARROW)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. Only these rows meet the shards' starts."""
    shards = spark.read.schema(_SHARD).parquet(f"{folder}/shards").select("part", "shard", "doc_ids", "data")
    found = shards.mapInArrow(_digests, _READ)
    return found.join(_starts(spark, folder), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


_TOKEN_ARROW = pa.schema([("place", pa.int64()), ("token", pa.int64())])


def _tokens_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            shard, first = Shard(batch.column("data")[row].as_buffer().to_pybytes()), batch.column("first")[row].as_py()
            places = batch.column("places")[row].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([shard.token(p - first) for p in places], pa.int64())], schema=_TOKEN_ARROW)


def tokens_at(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """place, token for each ``place`` (count from the first id of all) that the files have."""
    starts = _starts(spark, folder)
    width = F.lit(SHARD_IDS)
    bins = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("ids") - 1) / width))
    asked = places.select(F.col("place").cast("long")).distinct().withColumn("bin", F.floor(F.col("place") / width))
    inside = asked.join(starts.withColumn("bin", F.explode(bins)), "bin").where("place >= first and place < first + ids")
    asked = inside.groupBy("part", "shard", "first").agg(F.collect_list("place").alias("places"))
    shards = spark.read.schema(_SHARD).parquet(f"{folder}/shards").select("part", "shard", "data")
    return shards.join(asked, ["part", "shard"]).mapInArrow(_tokens_at, "place long, token long")


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    """Every text of documents as token ids: written, and read back from the files."""
    folder = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_digests(spark, folder)
