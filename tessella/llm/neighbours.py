"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs, one to a shard.

Vectors are dealt to shards by hash. In a shard every vector gets one more component, so that all have one length and the
largest inner product is the smallest distance. The graph is built in rounds: beam searches from the middle propose
neighbours of each vector, and pruning keeps a candidate only if no kept neighbour is closer to it by the relaxed
factor, so edges stay diverse; back edges are pruned alike. A query walks the graph of every shard with a beam, and the
shards' best are ranked by the exact inner product in double precision. Equal vectors are one vertex of the graph, since
pruning would leave most copies without an edge to them; the vertex holds their ids, and answers name them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Vectors of a shard, about: every query walks every shard, so larger ones cost less in all, and smaller ones build faster.
SHARD = 16_000
#: Edges of a vector, width of the beam in building and in search, and the relaxation of the distance pruning.
DEGREE, BUILD_BEAM, BEAM, RELAX = 48, 80, 160, 1.15
#: Neighbours that a query gets, and which rows are queries.
NEAREST, EVERY = 20, 20
#: Queries that walk a graph together.
TOGETHER = 256


def lengthened(x: np.ndarray) -> np.ndarray:
    """The vectors with a component that gives all of them the length of the longest."""
    squares = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))[:, None]], axis=1)


def walk(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's vectors and their squared distances, nearest first; -1 where the walk met fewer."""
    n, m = len(points), len(queries)
    norms = (points * points).sum(axis=1)
    seen = np.zeros((m, n), bool)
    ids = np.full((m, beam), -1)
    far = np.full((m, beam), np.inf)
    done = np.ones((m, beam), bool)
    first = starts[:beam]
    k = len(first)
    seen[:, first] = True
    ids[:, :k], far[:, :k], done[:, :k] = first, norms[first] - 2 * queries @ points[first].T, False
    rows = np.arange(m)
    active = rows
    while len(active):
        open_ = np.where(done[active], np.inf, far[active])
        pick = open_.argmin(axis=1)
        more = np.isfinite(open_[np.arange(len(active)), pick])
        active, pick = active[more], pick[more]
        if not len(active):
            break
        done[active, pick] = True
        near = edges[ids[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, ids[active, pick][:, None])] = True
        found = np.where(fresh, norms[near] - 2 * np.einsum("ad,aed->ae", queries[active], points[near]), np.inf)
        every = np.concatenate([far[active], found], axis=1)
        best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(active))[:, None]
        far[active] = every[at, best]
        ids[active] = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)[at, best]
        done[active] = np.concatenate([done[active], ~fresh], axis=1)[at, best]
    order = np.argsort(far, axis=1, kind="stable")
    return ids[rows[:, None], order], far[rows[:, None], order]


def prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """For each vector of own the candidates (-1: none) that robust pruning keeps, nearest first."""
    m = len(own)
    gaps = points[candidates] - points[own][:, None]
    far = np.where((candidates < 0) | (candidates == own[:, None]), np.inf, np.einsum("acd,acd->ac", gaps, gaps))
    order = np.argsort(far, axis=1, kind="stable")
    at = np.arange(m)[:, None]
    candidates, far = candidates[at, order], far[at, order]
    # the same vector twice stands side by side
    far[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
    kept = np.full((m, degree), -1)
    for k in range(degree):
        pick = far.argmin(axis=1)
        live = np.isfinite(far[at[:, 0], pick])
        if not live.any():
            break
        chosen = np.where(live, candidates[at[:, 0], pick], -1)
        kept[:, k] = chosen
        gaps = points[candidates] - points[chosen][:, None]
        apart = np.einsum("acd,acd->ac", gaps, gaps)
        far[live[:, None] & (relax * relax * apart <= far)] = np.inf
        far[at[:, 0], pick] = np.inf
    return kept


def build(points: np.ndarray, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of the graph over points: rows of DEGREE vectors, -1 where there are fewer, and where walks begin."""
    n = len(points)
    rng = np.random.default_rng(seed)
    middle = ((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()
    starts = np.unique(np.append(rng.choice(n, min(n, 15), replace=False), middle))
    if n <= DEGREE + 1:
        edges = np.full((n, DEGREE), -1)
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, starts
    edges = rng.integers(0, n, (n, DEGREE))
    for relax in (1.0, RELAX):
        order = rng.permutation(n)
        for i in range(0, n, TOGETHER):
            own = order[i : i + TOGETHER]
            met, _ = walk(points, edges, starts, points[own], BUILD_BEAM)
            edges[own] = prune(points, own, np.concatenate([met, edges[own]], axis=1), relax=relax)
        source, target = np.repeat(np.arange(n), DEGREE), edges.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sort = np.argsort(target, kind="stable")
        source, target = source[sort], target[sort]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        for part in range(int(place.max(initial=0)) // (4 * DEGREE) + 1):  # those of a vector with many are taken in by turns
            back = np.full((n, 4 * DEGREE), -1)
            fits = place // (4 * DEGREE) == part
            back[target[fits], place[fits] % (4 * DEGREE)] = source[fits]
            for i in range(0, n, TOGETHER):
                own = np.arange(i, min(n, i + TOGETHER))
                own = own[(back[own] >= 0).any(axis=1)]
                if len(own):
                    edges[own] = prune(points, own, np.concatenate([edges[own], back[own]], axis=1), relax=relax)
    return edges, starts


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors in double precision that are neither null nor zero and have finite components only."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(finite & F.exists("x", lambda c: c != 0))


def vertices(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct vectors, ids, begins): begins[i] to begins[i + 1] is where the ids of vector i stand, each once and in order."""
    at, vertex = np.unique(x + 0.0, axis=0, return_inverse=True)  # -0.0 becomes 0.0
    pairs = np.unique(np.stack([vertex.ravel(), ids], axis=1), axis=0)
    return at, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))


def _search_shard(_: tuple, batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """Reads a shard's vectors (kind 0, sorted to come first) and queries (kind 1); gives each query's best of the shard."""
    names = ["query_id", "vec_id", "score"]
    vectors: dict[int, tuple[list, list]] = {}  # by length, since those of different lengths have no product
    graphs: dict[int, tuple] = {}
    asked: dict[int, tuple[list, list]] = {}

    def graph_of(length: int) -> tuple:
        if length not in graphs:
            ids, rows = vectors.pop(length)
            at, own, begins = vertices(np.array(rows), np.array(ids))
            points = lengthened(at)
            graphs[length] = (points, *build(points), own, begins, at)
        return graphs[length]

    def answers(length: int, query_ids: list, queries: list) -> pa.RecordBatch:
        points, edges, starts, own, begins, at = graph_of(length)
        q = np.array(queries)
        met, _ = walk(points, edges, starts, np.concatenate([q, np.zeros((len(q), 1))], axis=1), max(BEAM, 2 * nearest))
        query_ids = np.array(query_ids)
        scores = np.where(met >= 0, np.einsum("ad,abd->ab", q, at[met]), -np.inf)
        # of each vertex the least ids, as many as may be answers beside the query's own
        n = np.where(met >= 0, np.minimum(begins[met + 1] - begins[met], nearest + 1), 0)
        line = np.repeat(np.arange(len(q)), n.sum(axis=1))
        n = n.ravel()
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = own[np.repeat(begins[met].ravel(), n) + place]
        scores = np.repeat(scores.ravel(), n)
        real = found != query_ids[line]
        line, found, scores = line[real], found[real], scores[real]
        order = np.lexsort((found, -scores, line))
        line, found, scores = line[order], found[order], scores[order]
        keep = np.arange(len(line)) - np.searchsorted(line, line) < nearest
        return pa.RecordBatch.from_arrays([pa.array(query_ids[line[keep]]), pa.array(found[keep]), pa.array(scores[keep])], names)

    for batch in batches:
        for kind, vec_id, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "vec_id", "x")), strict=True):
            held = (vectors if kind == 0 else asked).setdefault(len(x), ([], []))
            held[0].append(vec_id)
            held[1].append(x)
            if kind and len(held[0]) == TOGETHER and (len(x) in vectors or len(x) in graphs):
                yield answers(len(x), *asked.pop(len(x)))
    for length, held in asked.items():
        if length in vectors or length in graphs:
            yield answers(length, *held)


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id every divides, by the contract of op6.

    Null, zero or non-finite vectors, and rows without a vec_id, take no part; vectors of different lengths are no
    candidates of each other. Of equal scores (ties) the smaller vec_id comes first. Equal
    vectors are candidates each; of rows that repeat a vec_id each is a query and a candidate, but none of its own
    namesakes', and the repeated answers count once. An empty table gives an empty result; further columns are ignored.
    """
    rows = settle(_valid(vectors))
    shards = max(1, -(-rows.count() // shard))
    home = F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(shards)).cast("int")
    stored = rows.select(home.alias("shard"), F.lit(0).alias("kind"), "vec_id", "x")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "x")
    dealt = stored.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's shards, one after the other: rows come sorted by shard."""
        source = (
            part for batch in batches if batch.num_rows
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1) for part in [batch.slice(part[0], len(part))]
        )
        head = next(source, None)
        while head is not None:
            now, rest = head.column("shard")[0].as_py(), [head]
            head = None

            def own(now=now, rest=rest) -> Iterator[pa.RecordBatch]:
                nonlocal head
                yield rest.pop()
                for part in source:
                    if part.column("shard")[0].as_py() != now:
                        head = part
                        return
                    yield part

            yield from _search_shard((now,), own(), nearest)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= nearest)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
