"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by centroids of its own; a pair of centroids is a
cell. A query visits cells in the order of the sum of both squared distances, with a heap over
the two sorted lists, until the cells hold ``reach`` rows; all rows of these cells are then ranked
by their exact distance. Centroids are fitted on a bounded sample; every row is in a cell.
``reach`` is set so that on a sample of queries, held against all rows, the recall is as asked for.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import needed, staged

RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class MultiIndex:
    """``centroids``: an array for each half. ``counts``: the rows in each pair of centroids.
    ``recall``: of the sample of queries at this ``reach``, 1 if there was none."""

    centroids: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    reach: int
    recall: float

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.centroids[0].shape[1]
        return tuple(_squared(part, c) for part, c in zip((vectors[:, :cut], vectors[:, cut:]), self.centroids, strict=True))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(1) * len(self.centroids[1]) + b.argmin(1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by the sum of a query's distances to both, as (cell, rows in it). Pairs
    are pushed once, when both their neighbours nearer to the query have been taken."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, i, j = first[one].tolist(), second[two].tolist(), one.tolist(), two.tolist()
    heap, taken, width = [(a[0] + b[0], 0, 0)], [0] * len(a), len(b)  # taken: how many of a row's pairs
    while heap:
        _, x, y = heapq.heappop(heap)
        taken[x] = y + 1
        cell = i[x] * width + j[y]
        yield cell, int(counts[cell])
        if x + 1 < len(a) and taken[x + 1] == y:
            heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
        if y + 1 < width and (x == 0 or taken[x - 1] > y + 1):
            heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means of distinct vectors; fewer centroids if there are fewer vectors."""
    sample = np.unique(sample, axis=0)
    draw = np.random.default_rng(seed)
    found = sample[draw.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = _squared(sample, found).argmin(1)
        sums, size = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, sample)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def vectors_of(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, repeated rows once. Null, empty and zero
    vectors, those with components that are null or not finite, rows without an id, and
    vectors of another length than the commonest (of equally common ones the longest) don't."""
    rows = needed(embeddings, id, vector).select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(F.coalesce(good, F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("vector") == (common["dim"] if common else 0)).distinct()


def _nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place, ids, distances) the k nearest rows but those of its own id, ties to
    the smaller id. Products only choose; distances are taken from differences."""
    rough = _squared(queries, rows)
    rough[ids[:, None] == row_ids[None]] = np.inf
    slack = 1e-9 * ((queries * queries).sum(1) + (rows * rows).sum(1).max())
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(queries), np.inf)
    for q in range(len(queries)):
        near = np.flatnonzero((rough[q] <= edge[q] + slack[q]) & (rough[q] < np.inf))
        exact = np.sqrt(((rows[near] - queries[q]) ** 2).sum(1))
        order = np.lexsort((row_ids[near], exact))[:k]
        yield q, row_ids[near][order], exact[order]


def _sample(rows: DataFrame, most: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows, those with the smallest hashes."""
    found = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(most).toArrow()
    return found.column(0).to_numpy(), _matrix(found.column(1)) if found.num_rows else np.zeros((0, 0))


def build_index(rows: DataFrame, queries: DataFrame, *, k: int = 10, recall: float = 0.95, per_cell: int = 64, most_centroids: int = 256, sample_rows: int = 20_000, sample_queries: int = 200) -> tuple[MultiIndex, DataFrame]:
    """The index and the rows with their ``cell``. ``rows``: from :func:`vectors_of`; ``queries`` alike.

    A half has about as many centroids as leave ``per_cell`` rows to a cell, at most
    ``most_centroids``, fitted on at most ``sample_rows`` rows. At most ``sample_queries`` queries are
    held against all rows, in one pass; ``reach`` is the least number of visited rows that finds
    ``recall`` of their ``k`` nearest, all of their cells counted in.
    """
    n = rows.count()
    sample = _sample(rows, sample_rows, "centroids")[1]
    dim = sample.shape[1]
    cut = dim // 2 or dim
    count = max(1, min(most_centroids, round(math.sqrt(n / per_cell))))
    halves = [fit_centroids(sample[:, :cut], count), fit_centroids(sample[:, cut:], count) if cut < dim else np.zeros((1, 0))]
    blank = MultiIndex((halves[0], halves[1]), np.zeros(len(halves[0]) * len(halves[1]), np.int64), 0, 1.0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = blank.cells(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "vector", "cell"])

    indexed = staged(rows.select("vec_id", "vector").mapInArrow(assign, "vec_id long, vector array<double>, cell int"), "vectors")
    counts = np.zeros(len(blank.counts), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # no more than pairs of centroids
        counts[r["cell"]] = r["count"]
    ids, vectors = _sample(queries, sample_queries, "queries")
    if not len(ids):
        return MultiIndex(blank.centroids, counts, n, 1.0), indexed

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, found = batch.column("cell").to_numpy(), []
                own = np.arange(batch.num_rows)
                others = batch.column("vec_id").to_numpy()
                rough = _squared(vectors, _matrix(batch.column("vector")))
                rough[ids[:, None] == others[None]] = np.inf
                for q in range(len(ids)):
                    near = own[np.argpartition(rough[q], k - 1)[:k]] if batch.num_rows > k else own
                    found += [(q, float(rough[q, x]), int(cells[x])) for x in near.tolist() if rough[q, x] < np.inf]
                q, d, c = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.float64()), pa.array(c, pa.int32())], names=["q", "d", "cell"])

    best = Window.partitionBy("q").orderBy("d")
    true = indexed.mapInArrow(search, "q int, d double, cell int").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "cell").collect()
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["q"], []).append(r["cell"])
    first, second = blank.distances(vectors)
    need = []
    for q, cells in wanted.items():
        seen, missing = 0, set(cells)
        at = {}
        for cell, size in traverse(first[q], second[q], counts):
            # a query goes on while it has visited fewer rows than reach, so the cell is visited if reach is more than those before it
            at[cell] = seen + 1
            seen += size
            missing.discard(cell)
            if not missing:
                break
        need += [at[c] for c in cells]
    need.sort()
    reach = need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)] if need else n
    return MultiIndex(blank.centroids, counts, reach, sum(x <= reach for x in need) / max(1, len(need))), indexed


def _dealt(table: DataFrame, own: dict[int, int], others: dict[int, int], most: int, names: tuple[str, str]) -> DataFrame:
    """Rows of one side with the pieces in which they meet the other side's: ``names[0]``, by a hash,
    about ``most`` rows to a piece, and ``names[1]``, all pieces of the other side. The table of
    pieces has a row for each centroid at most."""
    size = lambda n: -(-n // most)
    pieces = table.sparkSession.createDataFrame([(f, size(own[f]), size(others[f])) for f in own.keys() & others.keys()], "first int, __own int, __others int")
    met = table.join(F.broadcast(pieces), "first")
    return met.withColumns({names[0]: F.pmod(F.xxhash64("vec_id"), F.col("__own")).cast("int"), names[1]: F.explode(F.sequence(F.lit(0), F.col("__others") - 1))}).drop("__own", "__others")


def nearest(embeddings: DataFrame, *, every: int = 100, k: int = 10, recall: float = 0.95, piece_rows: int = 2048, **given) -> DataFrame:
    """The ``k`` nearest found rows of each row whose vec_id is divisible by ``every``: query_id, rank
    (from 1), vec_id, score (Euclidean distance in double precision), ties to the smaller vec_id.

    Rows that take part: see :func:`vectors_of`. A query's own row, and others of its id, aren't
    candidates; with fewer than k candidates all are given. Repeated rows are one; if an id
    has several vectors, its query is the least of them, and each is a candidate. An empty table
    gives no rows. ``given``: the parameters of :func:`build_index`.

    Of equal vectors the ``k`` + 1 smallest ids are candidates: no query can have others among its
    nearest, since ties go to the smaller id. Rows and queries meet by the centroid of the first
    half, in pieces of about ``piece_rows`` rows of either side, so a centroid with a third of
    all rows or queries is many tasks' work; inside, only visited cells are compared.
    """
    spark = embeddings.sparkSession
    rows = staged(vectors_of(embeddings), "rows")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    candidates = staged(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "vector"), "candidates")
    if candidates.isEmpty():
        return spark.createDataFrame([], RESULT)
    index, indexed = build_index(candidates, queries, k=k, recall=recall, **given)
    # with fewer rows than wanted neighbours near by, cells are visited until there are some to spare
    reach = max(index.reach, 2 * k + 2)

    width = len(index.centroids[1])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.distances(_matrix(batch.column(1)))
            query, firsts, seconds = [], [], []
            for q in range(batch.num_rows):
                seen, visited = 0, {}
                for cell, size in traverse(first[q], second[q], index.counts):
                    if seen >= reach:
                        break
                    seen += size
                    if size:
                        visited.setdefault(cell // width, []).append(cell % width)
                query += [q] * len(visited)
                firsts += visited.keys()
                seconds += visited.values()
            for at in range(0, len(query), 8192):
                part = pa.array(query[at : at + 8192])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(firsts[at : at + 8192], pa.int32()), pa.array(seconds[at : at + 8192], pa.list_(pa.int32()))], names=["vec_id", "vector", "first", "seconds"])

    probes = staged(queries.repartition("vec_id").mapInArrow(probe, "vec_id long, vector array<double>, first int, seconds array<int>"), "probes")
    asked = {r["first"]: r["count"] for r in probes.groupBy("first").count().collect()}
    sizes = {f: int(n) for f, n in enumerate(index.counts.reshape(-1, width).sum(1).tolist()) if n}
    placed = indexed.select("vec_id", "vector", F.floor(F.col("cell") / width).cast("int").alias("first"), (F.col("cell") % width).alias("second"))

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("second")
            matrix, ids, second = _matrix(rows.column("vector")), rows.column("vec_id").to_numpy(), rows.column("second").to_numpy()
            asking, own, visits = _matrix(queries.column("vector")), queries.column("vec_id").to_numpy(), queries.column("seconds").combine_chunks()
            visitor, visited = np.repeat(np.arange(len(own)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
            for cell in np.unique(second):
                a, b = np.searchsorted(second, [cell, cell + 1])
                here = visitor[visited == cell]
                for at in range(0, len(here), 256):
                    some = here[at : at + 256]
                    found += [(np.full(len(near), own[some[q]]), near, score) for q, near, score in _nearest(asking[some], own[some], matrix[a:b], ids[a:b], k)]
        query, near, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((near, score, query))  # the best k of each query in this group
        query, near, score = query[order], near[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        best = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
        return pa.table({"query_id": pa.array(query[best], pa.int64()), "vec_id": pa.array(near[best], pa.int64()), "score": pa.array(score[best], pa.float64())})

    keys = ("first", "r", "q")
    left, right = _dealt(placed, sizes, asked, piece_rows, ("r", "q")), _dealt(probes, asked, sizes, piece_rows, ("q", "r"))
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
