"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Tokens are runs of letters and digits (bytes over 127 count as letters) and single runs of other
signs, both as they are, so that odd marks and capitals are words of their own, and one token for
any word that repeats the word before it. Every token has an
*index vector*, a few +1 and -1 at places that its hash gives. A token's *word vector* is its index
vector plus the mean of those of its neighbours (``REACH`` on either side, moved on by one place
for each step of distance, so that order counts) over all texts, labelled or not, summed in Spark. A document's features
are the mean of its tokens' word vectors, the length of that mean, and log of its token count.

The network has one hidden layer (tanh) and a sigmoid, trained with numpy on at most
``TRAIN_ROWS`` labelled rows, picked by a hash of their ids; a fifth of them is kept back, and a
temperature fitted on it calibrates the probabilities. Only their features reach the driver, so no text is
too long for the sample. Word vectors are kept for the ``VOCABULARY``
most frequent tokens of all texts; any other token has its index vector alone. So the model has a
fixed size, and scoring is a narrow map over whole texts.

Defined cases: null and empty texts get the score of an all-zero vector. Labels that are null or
neither 0 nor 1 are left out; a document with several labels counts once for each. Without both
labels among the training rows every score is the mean label (0.5 without any). A null id is held out and scored
like any other; repeated rows are scored one by one. An empty table gives no row. Texts are used whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, runs, slices, string_parts

#: Width of the vectors and signs in an index vector.
DIMENSIONS = 128
SIGNS = 4
REACH = 2
VOCABULARY = 20_000
#: Bound on the labelled rows that the network is fitted on.
TRAIN_ROWS = 4_000
#: Tokens whose sums travel together.
_SUM_BLOCK = 512
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_SIGN = ~_ALNUM
_SIGN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, its row), in the order of the text. A word that repeats the word before it is the
    token ``_AGAIN``, so that repetition has a word vector too."""
    words, signs = Words(data, offsets, inside=_ALNUM), Words(data, offsets, inside=_SIGN)
    hashes, rows = words.hashes(), words.rows()
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])) + 1
    hashes[again] = _AGAIN
    start = np.concatenate([words.starts, signs.starts])
    order = np.argsort(start, kind="stable")
    return np.concatenate([hashes, signs.hashes()])[order], np.concatenate([rows, signs.rows()])[order]


def index_vectors(tokens_: np.ndarray, dimensions: int = DIMENSIONS, signs: int = SIGNS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): SIGNS entries of each token's sparse vector."""
    step = mixed(tokens_[:, None] + np.arange(1, signs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (step % np.uint64(dimensions)).astype(np.int64), np.where(step >> np.uint64(63), 1.0, -1.0).astype(np.float32)


@dataclass
class Model:
    """All that scoring needs; its size doesn't depend on the corpus."""

    known: np.ndarray  # sorted token hashes
    context: np.ndarray  # what the neighbours add, for each of them
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of features for each text."""
        hashes, row = tokens(data, offsets)
        n, width = len(offsets) - 1, self.context.shape[1]
        total = np.zeros((n, width), np.float64)
        if len(hashes):
            # Equal tokens of a text are looked up once.
            order = np.lexsort((hashes, row))
            h, r = hashes[order], row[order]
            head = runs(r, h)
            count = np.diff(np.append(head, len(h))).astype(np.float64)
            h, r = h[head], r[head]
            place, value = index_vectors(h, width)
            total += np.bincount((r[:, None] * width + place).ravel(), (value * count[:, None]).ravel(), n * width).reshape(n, width)
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                hit = np.flatnonzero(self.known[at] == h)
                if len(hit):
                    first = runs(r[hit])
                    total[r[hit][first]] += np.add.reduceat(self.context[at[hit]] * count[hit, None], first, axis=0)
        size = np.bincount(row, minlength=n).astype(np.float64)
        mean = total / np.maximum(size, 1)[:, None]
        return np.column_stack([mean, np.linalg.norm(mean, axis=1), np.log1p(size)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return _sigmoid(self.logits(self.features(data, offsets)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _neighbour_sums(names: np.ndarray, hashes: np.ndarray, row: np.ndarray, total: np.ndarray, seen: np.ndarray) -> None:
    """Adds to ``total`` the neighbours' moved index vectors of each of ``names`` in some texts, to ``seen`` how often it is there."""
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    mine = names[at] == hashes
    dimensions = total.shape[1]
    flat = total.reshape(-1)
    for step in [*range(-REACH, 0), *range(1, REACH + 1)]:
        i = np.arange(max(0, -step), len(hashes) - max(0, step))
        i = i[mine[i] & (row[i] == row[i + step])]
        place, value = index_vectors(hashes[i + step], dimensions)
        np.add.at(flat, (at[i][:, None] * dimensions + (place + step) % dimensions).ravel(), value.astype(np.int32).ravel())
    seen += np.bincount(at[mine], minlength=len(names))


_COUNTED_ARROW = pa.schema([("token", pa.int64()), ("times", pa.int64())])


def _token_counts(flush_tokens: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[k:k + 100_000].view(np.int64)), pa.array(times[k:k + 100_000])], schema=_COUNTED_ARROW)

        held, size = [], 0
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in slices(offsets):
                held.append(tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[0])
                size += len(held[-1])
                if size >= flush_tokens:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return task


_SUMS_ARROW = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def _summed(shared, dimensions: int):
    """A task's sums in blocks of ``_SUM_BLOCK`` tokens: how often each is there, then its vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        total, seen = np.zeros((len(names), dimensions), np.int32), np.zeros(len(names), np.int64)
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in slices(offsets):
                _neighbour_sums(names, *tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), total, seen)
        for k in range(0, len(names), _SUM_BLOCK):
            if seen[k:k + _SUM_BLOCK].any():
                part = np.column_stack([seen[k:k + _SUM_BLOCK], total[k:k + _SUM_BLOCK]]).astype(np.int64)
                # Most numbers are small: the narrowest type holds them.
                kind = np.min_scalar_type(-int(np.abs(part).max()) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k // _SUM_BLOCK], pa.int32()), pa.array([kind.char.encode() + zlib.compress(part.astype(kind).tobytes(), 1)], pa.binary())], schema=_SUMS_ARROW)

    return task


def _unpacked(sums: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sums[1:]), np.dtype(sums[:1].decode())).astype(np.int64)


def _added():
    def add(table: pa.Table) -> pa.Table:
        total = 0
        for sums in table.column("sums"):
            total = total + _unpacked(sums.as_py())
        return pa.table([table.column("block").slice(0, 1), pa.array([b"q" + zlib.compress(total.tobytes(), 1)], pa.binary())], schema=_SUMS_ARROW)

    return add


def word_vectors(docs: DataFrame, vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS, flush_tokens: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(the most frequent tokens of all texts, sorted; mean of their neighbours' moved index vectors)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_token_counts(flush_tokens), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    names = np.sort(counts.orderBy(F.desc("times"), "token").limit(vocabulary).select("token").toArrow().column("token").to_numpy().view(np.uint64))
    total, seen = np.zeros((len(names), dimensions), np.float32), np.zeros(len(names))
    if len(names):
        parts = rows.mapInArrow(_summed(spark.sparkContext.broadcast(names), dimensions), "block int, sums binary")
        for block, sums in parts.groupBy("block").applyInArrow(_added(), "block int, sums binary").toLocalIterator():
            part = _unpacked(bytes(sums)).reshape(-1, dimensions + 1)
            seen[block * _SUM_BLOCK:block * _SUM_BLOCK + len(part)], total[block * _SUM_BLOCK:block * _SUM_BLOCK + len(part)] = part[:, 0], part[:, 1:]
    return names, total / np.maximum(seen * 2 * REACH, 1)[:, None].astype(np.float32)


def fit(x: np.ndarray, labels: np.ndarray, known: np.ndarray, context: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Network and temperature from rows of features, which come from these word vectors."""
    y = np.asarray(labels, np.float64)
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(known[:0], context[:0], none, none, none, none, none, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    model = Model(known, context, none, none, none, none, none, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, use = order[:len(y) // 5], order[len(y) // 5:]
    if len(back) < 10 or len(np.unique(y[use])) < 2:
        back, use = order, order
    model.shift, model.scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    w = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    z = (x - model.shift) / model.scale
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
            a = np.tanh(z[batch] @ w["w1"] + w["b1"])
            error = (_sigmoid(a @ w["w2"] + w["b2"]) - y[batch]) / len(batch)
            deep = np.outer(error, w["w2"]) * (1 - a * a)
            slope = {"w1": z[batch].T @ deep + 1e-4 * w["w1"], "b1": deep.sum(axis=0), "w2": a.T @ error + 1e-4 * w["w2"], "b2": np.array([error.sum()])}
            t += 1
            for k in w:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * slope[k]
                second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
                w[k] = w[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = w["w1"], w["b1"], w["w2"], float(w["b2"][0])
    logit = model.logits(x[back])
    # The temperature is the one of a fixed ladder with the least log loss on the rows kept back.
    ladder = np.geomspace(0.25, 16, 121)
    loss = [-np.mean(np.where(y[back] > 0.5, np.log(p := np.clip(_sigmoid(logit / h), 1e-9, 1 - 1e-9)), np.log(1 - p))) for h in ladder]
    model.temperature = float(ladder[int(np.argmin(loss))])
    return model


_SAMPLE_ARROW = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("key", pa.int64()), ("x", pa.binary())])


def _sampled(shared):
    """The features of each labelled text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            for a, b in slices(offsets):
                x = model.features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), part.column("key"), pa.array([v.tobytes() for v in x], pa.binary())], schema=_SAMPLE_ARROW)

    return task


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``train_rows`` of the rows that ``docs`` and
    ``labels`` (doc_id, quality) share, in the order of a hash of their ids. Texts of any length count alike:
    the driver sees their features alone."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    # The sample is drawn from the narrow table first, so that few texts travel.
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    known, context = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(Model(known, context, *[np.zeros(0)] * 5, 0.0, 1.0))
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = found.select("doc_id", "quality", F.xxhash64("text").alias("key"), "text").mapInArrow(_sampled(shared), "doc_id long, quality int, key long, x binary")
    data = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "key").limit(train_rows).toArrow()
    x = np.frombuffer(b"".join(data.column("x").to_pylist()), np.float64).reshape(data.num_rows, -1) if data.num_rows else np.zeros((0, DIMENSIONS + 2))
    return fit(x, data.column("quality").to_numpy(), known, context)


_SCORE_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY x DIMENSIONS numbers at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            found = [shared.value.scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())], schema=_SCORE_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by the check sum of its id as text; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
