"""Exact top-k by inner product with M-trees.

Vectors are scaled to integers. Among vectors of any length the inner product with a query orders them as does the
distance after one more coordinate is added: for a candidate x the root of M - |x|^2, where M bounds all squared norms,
for a query 0; then |q - x|^2 = |q|^2 + M - 2 q.x. All squared distances are integers, so the order is exact.

The candidates are dealt to parts of bounded size. Each part is a paged M-tree: leaves of vectors, inner nodes of routing
vectors with covering radii, every entry with its distance to its node's routing vector. Queries stream past the part's
tree: best-first by the least possible distance of a node; an entry whose stored parent distance already rules it out by
the triangle inequality is skipped before its own distance is computed. The parts' best k are merged per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = 64
PART_ROWS = 8_192
SCHEMA = "query_id long, vec_id long, score long"


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long; null for a null vector, or one with a null or non-finite component."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(scale * v).cast("long")))


class MTree:
    """Paged metric tree over integer vectors that are extended by ``extra`` (their last coordinate, a root)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, bound: int):
        self.x, self.ids = vectors, ids
        self.norm = (vectors * vectors).sum(axis=1)
        self.extra = np.sqrt((bound - self.norm).astype(float))
        self.bound = bound
        order, cuts = self._cluster(np.arange(len(ids)))
        self.leaf_rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        # routing vector of a page: the member nearest to its mean; radius and parent distances in floating point
        pages = [self._route(r, np.zeros(len(r))) for r in self.leaf_rows]
        self.leaf = self._level(pages)
        self.inner: list[tuple] = []
        level = self.leaf
        while len(level[0]) > PAGE:
            groups, at = self._cluster(level[0])
            rank = {int(row): i for i, row in enumerate(level[0])}  # a page's routing vector is its own member, so they differ
            pos = np.array([rank[int(row)] for row in groups])
            children = [pos[a:b] for a, b in zip(at, at[1:])]
            pages = [self._route(level[0][c], level[1][c]) for c in children]
            above = self._level(pages)
            self.inner.append((level, children, [p[2] for p in pages]))
            level = above
        self.top = level
        self.leaf_parent = [self._distance(self.leaf[0][i], r) for i, r in enumerate(self.leaf_rows)]

    @staticmethod
    def _level(pages: list[tuple]) -> tuple:
        return np.array([p[0] for p in pages]), np.array([p[1] for p in pages])

    def _distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        d = self.x[rows] - self.x[row]
        return np.sqrt((d * d).sum(axis=1) + (self.extra[rows] - self.extra[row]) ** 2)

    def _route(self, rows: np.ndarray, radii: np.ndarray) -> tuple:
        mean = self.x[rows].mean(axis=0)
        row = int(rows[np.argmin(((self.x[rows] - mean) ** 2).sum(axis=1))])
        d = self._distance(row, rows)
        return row, float((d + radii).max()), d

    def _cluster(self, rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Order rows so that pages of up to ``PAGE`` hold near ones: halve by distance to two far members."""
        out, cuts, todo = [], [0], [rows]
        while todo:
            r = todo.pop()
            if len(r) <= PAGE:
                out.append(r)
                cuts.append(cuts[-1] + len(r))
                continue
            a = int(r[np.argmax(self._distance(int(r[0]), r))])
            da = self._distance(a, r)
            b = int(r[np.argmax(da)])
            o = np.argsort(da - self._distance(b, r), kind="stable")
            half = len(r) // 2
            todo += [r[o[half:]], r[o[:half]]]
        return np.concatenate(out), cuts

    def search(self, q: np.ndarray, k: int, skip: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first, ties to the smaller id; id ``skip`` is left out."""
        qq, slack = int(q @ q), 1e-6

        def distance(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(qq + self.bound - 2 * (self.x[rows] @ q), 0).astype(float))

        best: list[tuple[int, int, int]] = []  # heap: worst first (score, -id, id)
        far = np.inf
        heap: list[tuple[float, int, int, float]] = []
        depth = len(self.inner)
        d = distance(self.top[0])
        for i in np.flatnonzero(d - self.top[1] <= far):
            heapq.heappush(heap, (max(0.0, d[i] - self.top[1][i]), depth, int(i), float(d[i])))
        while heap:
            low, level, node, dq = heapq.heappop(heap)
            if low > far * (1 + slack) + slack:
                break
            if level:
                below, children, parent = self.inner[level - 1]
                c = children[node]
                c = c[np.abs(dq - parent[node]) - below[1][c] <= far * (1 + slack) + slack]  # before any distance
                if len(c):
                    d = distance(below[0][c])
                    lows = d - below[1][c]
                    for i in np.flatnonzero(lows <= far * (1 + slack) + slack):
                        heapq.heappush(heap, (max(0.0, float(lows[i])), level - 1, int(c[i]), float(d[i])))
                continue
            rows = self.leaf_rows[node]
            rows = rows[np.abs(dq - self.leaf_parent[node]) <= far * (1 + slack) + slack]
            rows = rows[self.ids[rows] != skip]
            if not len(rows):
                continue
            scores, ids = self.x[rows] @ q, self.ids[rows]
            if len(best) == k:
                hit = scores >= best[0][0]
                scores, ids = scores[hit], ids[hit]
            for s, v in zip(scores.tolist(), ids.tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -v, v))
                elif (s, -v) > best[0][:2]:
                    heapq.heapreplace(best, (s, -v, v))
            if len(best) == k:
                far = float(np.sqrt(max(0, qq + self.bound - 2 * best[0][0])))
        return [(s, v) for s, _, v in sorted(best, reverse=True)]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", embedding_col: str = "embedding", scale: int = 256, part_rows: int = PART_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k vectors of highest inner product, all if fewer.

    A query's own id is no candidate. Ties go to the smaller id. Null ids, null vectors and vectors with null or
    non-finite components take no part, on either side. Vectors are compared with those of their own length; vectors of
    no component all have the product 0. Repeated rows of one id are candidates each, counted before they are dealt and
    kept ``k`` times at most, which no result can tell; a repeated query is asked once. An empty table gives no row.
    Further columns are not read.
    """
    x = integers(F.col(f"`{embedding_col}`"), scale)
    pick = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    data, asked = pick(vectors), pick(queries)
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    n, bound = data.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = -(-n // part_rows)
    dim = F.size("x").alias("dim")
    copies = data.groupBy("id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")).withColumn("_", F.explode(F.sequence(F.lit(1), "n")))
    cand = copies.select(F.lit(0).alias("kind"), "id", "x", dim, F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int").alias("part"))
    ask = asked.distinct().select(F.lit(1).alias("kind"), "id", "x", dim, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = cand.unionByName(ask).repartition(parts, "part").sortWithinPartitions("part", "dim", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree = None, [], None
        for b in batches:
            kinds, ids, dims, at = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            starts, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, int]] = []
            edges = np.flatnonzero(np.diff(at) | np.diff(dims) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)]):
                if (at[lo], dims[lo]) != group:
                    group, held, tree = (at[lo], dims[lo]), [], None
                x = flat[starts[lo] : starts[hi]].astype(np.int64).reshape(hi - lo, dims[lo])
                if kinds[lo] == 0:
                    held.append((x, ids[lo:hi].astype(np.int64)))
                    continue
                if not held:
                    continue
                tree = tree or MTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bound)
                for q, vector in zip(ids[lo:hi].tolist(), x):
                    out += [(q, v, s) for s, v in tree.search(vector, k, q)]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    found = dealt.select("kind", "id", "x", "dim", "part").mapInArrow(run, SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
