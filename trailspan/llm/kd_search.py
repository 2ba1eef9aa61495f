"""Exact search for the highest inner products with KD-trees, one for each shard of vectors.

Vectors become integers (floor of ``SCALE`` times each component), so scores are exact.

* *Index.* Tasks cut the rows they read, in order, into shards of ``SHARD_ROWS`` vectors and write a KD-tree for
  each: median splits of the widest dimension down to leaves of ``LEAF`` rows, a tight bounding box and the smallest id
  for each node. Where all vectors of a node are equal, it is split by ids. No shuffle, no limit on copies.
* *Search.* No score in a box is above the sum of max(q * low, q * high). A block of queries walks a tree best first: the
  node whose bound is furthest above the kth score of one of its queries is next, and goes on with those queries
  alone whose bound is not below their kth score (with an equal bound, only if it has an id small enough to win the tie).
* *Propagation.* Queries are dealt to groups, shards to sections. Each group first meets one section; the kth scores found
  there go with its queries to all other sections, and inside a section from shard to shard.

A task sees one section (a few shards) and one group of at most about ``GROUP`` queries; neither side grows with the
table. A group's queries go to every section: the work asked for is queries times rows, in blocks, less what bounds skip.

Defined cases: vectors that are null, empty or hold a null or a non-finite component, and rows without an id, take no part. The shorter of
two vectors counts as filled up with zeros. Each row is a candidate of its own, and shares no answer with rows of the
query's id; rows with the query's id and the same vector are one query, with another vector a query of their own, ranked
from 1 again. Equal scores are ordered by id. Scores must stay below 2^63, or the job is refused. An empty table gives no
row. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
K = 10
SHARD_ROWS = 16_384
LEAF = 128
#: Shards of a section, and queries of a group, about.
SECTION = 4
GROUP = 2048
#: Queries that walk a tree together.
TOGETHER = 64
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    width = np.diff(lists.offsets.to_numpy())
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("a component is too large for exact scores")
    out = np.zeros((len(lists), int(width.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < width[:, None]] = flat.astype(np.int64)
    return out


class Tree:
    """A KD-tree over some rows; leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, span: np.ndarray):
        """``span``: for each node first row, end, left child (0 for a leaf; the right one follows it), smallest id."""
        self.ids, self.vectors, self.low, self.high, self.span = ids, vectors, low, high, span

    @staticmethod
    def built(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order, low, high, span, todo = np.argsort(ids, kind="stable"), [], [], [], [(0, len(ids))]
        for first, end in todo:  # grows while it is walked
            mine = vectors[order[first:end]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            child = 0
            if end - first > leaf:
                wide = (high[-1] - low[-1]).argmax() if mine.shape[1] else 0
                half = (end - first) // 2
                if mine.shape[1] and high[-1][wide] > low[-1][wide]:
                    order[first:end] = order[first:end][np.argpartition(mine[:, wide], half)]
                else:
                    order[first:end] = order[first:end][np.argsort(ids[order[first:end]], kind="stable")]
                child = len(todo)
                todo += [(first, first + half), (first + half, end)]
            span.append((first, end, child, int(ids[order[first:end]].min())))
        return Tree(ids[order], vectors[order], np.array(low), np.array(high), np.array(span, np.int64))

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x, "<i8").tobytes() for x in (self.ids, self.vectors, self.low, self.high, self.span)]

    @staticmethod
    def read(dims: int, parts: list[bytes]) -> Tree:
        ids, vectors, low, high, span = (np.frombuffer(p, "<i8") for p in parts)
        return Tree(ids, vectors.reshape(len(ids), dims), low.reshape(-1, dims), high.reshape(-1, dims), span.reshape(-1, 4))


class Best:
    """The k best candidates of each query so far, and the kth score that a candidate has to reach."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        """``own``: the queries' ids; ``floor``: a kth score known from elsewhere."""
        self.own, self.floor, self.k = own, floor, k
        self.score, self.id = np.full((len(own), k), _NONE), np.full((len(own), k), _LAST)

    def kth(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score to reach, id below which an equal score still counts) of the queries ``q``."""
        score, ident = self.score[q, -1], self.id[q, -1]
        outside = self.floor[q] > score
        return np.where(outside, self.floor[q], score), np.where(outside, _LAST, ident)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``q`` (rows) with the candidates ``ids`` (columns)."""
        score, ident = self.kth(q)
        hit = ((scores > score[:, None]) | ((scores == score[:, None]) & (ids[None, :] <= ident[:, None]))) & (ids[None, :] != self.own[q][:, None])
        row, col = np.nonzero(hit)
        if not len(row):
            return
        some = np.unique(row)
        row = np.append(row, np.repeat(some, self.k))
        value = np.append(scores[hit], self.score[q[some]].ravel())
        name = np.append(ids[col], self.id[q[some]].ravel())
        order = np.lexsort([name, -value, row]) if value.min() > _NONE else np.lexsort([name, np.where(value == _NONE, _LAST, -np.where(value == _NONE, 0, value)), row])
        row, value, name = row[order], value[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.score[q[row[top]], place[top]], self.id[q[row[top]], place[top]] = value[top], name[top]


def search(tree: Tree, queries: np.ndarray, best: Best, together: int = TOGETHER) -> int:
    """Walk the tree best first with all queries and improve ``best``; returns the number of rows compared."""
    dims = max(queries.shape[1], tree.vectors.shape[1])
    queries, vectors, low, high = (_wide(x, dims) for x in (queries, tree.vectors, tree.low, tree.high))
    most = float(np.abs(queries).max(initial=0)) * float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * max(dims, 1)
    if most >= 2.0**63:
        raise OverflowError("scores don't fit 64 bits")
    kind = np.float64 if most < 2.0**53 else np.int64  # both exact; the first is faster
    queries, vectors, low, high = (x.astype(kind) for x in (queries, vectors, low, high))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    compared = 0
    for a in range(0, len(queries), together):
        q = np.arange(a, min(a + together, len(queries)))
        heap = [(0.0, 0, q, np.full(len(q), _LAST))]
        while heap:
            _, node, q, bound = heapq.heappop(heap)
            first, end, child, smallest = tree.span[node].tolist()
            score, ident = best.kth(q)
            on = (bound > score) | ((bound == score) & (smallest <= ident))
            q = q[on]
            if not len(q):
                continue
            if not child:
                best.add(q, (queries[q] @ vectors[first:end].T).astype(np.int64), tree.ids[first:end])
                compared += len(q) * (end - first)
                continue
            score, ident = score[on], ident[on]
            bounds = (up[q] @ high[child:child + 2].T + down[q] @ low[child:child + 2].T).astype(np.int64)
            for side in (0, 1):
                mine, smallest = bounds[:, side], int(tree.span[child + side, 3])
                on = (mine > score) | ((mine == score) & (smallest <= ident))
                if on.any():
                    gap = float((mine[on].astype(np.float64) - score[on].astype(np.float64)).max())
                    heapq.heappush(heap, (-gap, child + side, q[on], mine[on]))
    return compared


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


_SHARD = "shard long, dims int, ids binary, vectors binary, low binary, high binary, span binary"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("dims", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "low", "high", "span"))])


def _shards(rows: int, leaf: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, part = [], 0, 0, 0

        def shard(table: pa.Table) -> pa.RecordBatch:
            vectors = _matrix(table.column("vector").combine_chunks())
            tree = Tree.built(table.column("vec_id").to_numpy(), vectors, leaf)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([vectors.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in tree.packed())], schema=_SHARD_ARROW)

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            held.append(batch.select(["vec_id", "vector"]))
            size += batch.num_rows
            while size >= rows:
                table = pa.Table.from_batches(held)
                yield shard(table.slice(0, rows))
                held, size, number = table.slice(rows).to_batches(), size - rows, number + 1
        if size:
            yield shard(pa.Table.from_batches(held))

    return task


_FOUND = "query long, query_id long, vec_id long, score long"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")])


def _searched(k: int):
    def task(key: tuple, shards: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries) or not len(shards):
            return _FOUND_ARROW.empty_table()
        own = queries.column("query_id").to_numpy()
        best = Best(own, queries.column("floor").fill_null(_NONE).to_numpy(), k)
        vectors = _matrix(queries.column("vector").combine_chunks())
        for row in shards.to_pylist():
            search(Tree.read(row["dims"], [row[c] for c in ("ids", "vectors", "low", "high", "span")]), vectors, best)
        found = best.score > _NONE
        at = np.nonzero(found)[0]
        return pa.table([pa.array(queries.column("query").to_numpy()[at]), pa.array(own[at]), pa.array(best.id[found]), pa.array(best.score[found])], schema=_FOUND_ARROW)

    return task


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('inf') and not isnan(x))")


def _met(shards: DataFrame, queries: DataFrame, sections: int, groups: int, home: bool, k: int) -> DataFrame:
    """Each group of queries searched in its home section, or in all other ones."""

    def pick(other: str, mine: str, n: int) -> Column:
        all_of = F.sequence(F.lit(0), F.lit(n - 1))
        at_home = (lambda x: x % sections == F.col("section")) if other == "group" else (lambda x: x == F.col("group") % sections)
        return F.explode(F.filter(all_of, at_home if home else lambda x: ~at_home(x))).alias(other)

    left = shards.select("section", pick("group", "section", groups), "dims", "ids", "vectors", "low", "high", "span")
    right = queries.select("group", pick("section", "group", sections), "query", "query_id", "vector", "floor")
    return left.groupBy("section", "group").cogroup(right.groupBy("section", "group")).applyInArrow(_searched(k), _FOUND)


def top_k(table: DataFrame, asked: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF, section: int = SECTION, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row for which ``asked`` (over vec_id) holds."""
    rows = valid_vectors(table, id_col, vector_col)
    index = written(rows.withColumn("part", F.spark_partition_id()).mapInArrow(_shards(shard_rows, leaf), _SHARD), "kd-shards")
    queries = written(rows.where(asked).distinct().select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "vector"), "kd-queries")
    sections, groups = (max(1, -(-df.count() // n)) for df, n in ((index, section), (queries, group)))
    index = index.withColumn("section", F.pmod(F.xxhash64("shard"), F.lit(sections)).cast("int"))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    first = written(_met(index, queries.withColumn("floor", F.lit(None).cast("long")), sections, groups, True, k), "kd-first")
    floors = first.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    rest = _met(index, queries.join(floors, "query", "left"), sections, groups, False, k)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return first.unionAll(rest).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_kd_search(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth id of embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
