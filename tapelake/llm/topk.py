"""Exact top-k search by inner product with multi-resolution segment bounds.

Vectors are held in blocks. Of a pair of blocks, one of queries and one of candidates, segment means and deviations bound
every inner product from above (equally, every distance from below):
    q.x <= sum over segments of length * (mean_q * mean_x + dev_q * dev_x).
Bounds are taken coarse to fine; a pair whose bound falls below the k-th best score known is dropped; survivors are
scored exactly. Candidates whose bound equals the k-th best score stay, as a smaller id may win the tie.

The query set is stated (ids divisible by `every`) and meets all rows in blocks, held in the narrowest numbers that keep
them. Candidate blocks are dealt to groups, query blocks to a few shares; a task has one group and one share, keeps its
share's blocks and the k best of each query, and reads the candidates once. Candidates are copied COPIES times at most and
query blocks at most `every` times as often, so that what is shuffled grows with the rows; the driver gets counts alone.

Rules: vectors that are null, empty, or hold a null, NaN or infinite component take no part, nor do null ids; vectors
of different length are never compared; rows that repeat a query's id are its own; repeated rows each count, as queries
and as candidates; an empty table gives an empty result. Components of any finite size count exactly; a score beyond 64
bits is the nearest 64-bit value, and ranks go by that; a vector whose scaled components overflow a double takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.common import pick, written

LEVELS = (1, 4, 16)
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Times that a candidate is copied, unless a share of the queries has more than HELD bytes.
COPIES, HELD = 4, 64 << 20
#: Bytes of a block as doubles, components that wait for a block, and candidate blocks that a query block meets at once.
BLOCK_BYTES, WAITING, SOME = 1 << 20, 4 << 20, 8


def stats(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of `parts` segments of each row."""
    edge = np.linspace(0, x.shape[1], parts + 1).astype(int)
    edge = np.unique(edge)
    length = np.diff(edge).astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(x, edge[:-1], axis=1) / length
        square = np.add.reduceat(x * x, edge[:-1], axis=1) / length
        dev = np.sqrt(np.maximum(square - mean * mean, 0) + 1e-12 * square)  # at least the true one, whatever is lost to rounding
    return length, mean, dev


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and x, within 64 bits: by floats where these are exact, else by whole numbers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        large = ~(np.abs(q).max(axis=1)[:, None] * np.abs(x).max(axis=1)[None, :] * q.shape[1] < EXACT)
        product = q @ x.T
    out = np.where(large, 0, product).astype(np.int64)
    for i, j in np.argwhere(large).tolist():
        out[i, j] = min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))))
    return out


def below(score: int) -> float:
    """The greatest float that is surely less than the score; scores at the lower end of 64 bits tie with all beyond it."""
    return -np.inf if score <= LEAST else float(np.nextafter(float(score), -np.inf))


def sides(x: np.ndarray, query: bool) -> list[np.ndarray]:
    """Of each level what one product of a query's and a candidate's side makes the bound, with a slack for rounding, which follows the terms."""
    out = []
    for level in LEVELS:
        length, mean, dev = stats(x, level)
        with np.errstate(over="ignore", invalid="ignore"):
            terms = np.concatenate([mean * length, dev * length] if query else [mean, dev], axis=1)
            size = np.sqrt((terms * terms).sum(axis=1, keepdims=True))
        out.append(np.concatenate([terms, *([1e-9 * size, np.full_like(size, 1e-6)] if query else [size, np.ones_like(size)])], axis=1))
    return out


def hits(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray, q_sides: list[np.ndarray], x_sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, candidate ids and scores: what of this block can be among the k best of all, k for each query at most. x_ids ascend.

    least: for each query a bound below the k-th best score so far; it is raised to that of this block.
    """
    alive = q_ids[:, None] != x_ids[None, :]
    most_q, most_x = np.abs(q).max(initial=0), np.abs(x).max(initial=0)
    for a, b in zip(q_sides, x_sides, strict=True):
        if np.isneginf(least).all():  # nothing can be ruled out yet
            break
        with np.errstate(over="ignore", invalid="ignore"):
            bound = a @ b.T
        if max(most_q, most_x) > 1e60:
            bound[np.isnan(bound)] = np.inf  # beyond a double nothing is ruled out
        alive &= bound >= least[:, None]
        if not alive.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.flatnonzero(alive.any(axis=1))
    cols = np.flatnonzero(alive.any(axis=0))
    alive, floor = alive[np.ix_(rows, cols)], least[rows]
    with np.errstate(over="ignore"):
        exact = float(most_q) * float(most_x) * q.shape[1] < EXACT
    score = q[rows] @ x[cols].T if exact else exact_scores(q[rows], x[cols])
    alive &= score >= floor[:, None]
    if np.count_nonzero(alive) > 4 * k * len(rows):  # the k-th best of the block, and of its ties the smallest ids
        low = -np.inf if exact else LEAST
        if len(cols) > k:
            own = np.where(alive, score, low)
            kth = np.partition(own, len(cols) - k, axis=1)[:, len(cols) - k]
            tie = alive & (score == kth[:, None])
            above = alive & (score > kth[:, None])
            alive = above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]))
    i, j = np.nonzero(alive)
    s = score[i, j].astype(np.int64)
    i, c, s = best_rows(i, x_ids[cols][j], s, k)
    full = np.flatnonzero(np.bincount(i, minlength=len(rows)) == k)
    last = np.searchsorted(i, full, side="right") - 1
    for r, t in zip(rows[full].tolist(), s[last].tolist(), strict=True):
        least[r] = max(least[r], below(t))
    return rows[i], c, s


def best_rows(i: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (row, id, score) of each row, best first, ties to smaller ids."""
    order = np.lexsort((c, ~s, i))  # ~s descends without overflow
    i, c, s = i[order], c[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], c[keep], s[keep]


def best_of(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, known: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score): the k best of this block for each query, of those that can be among the k best of all.

    known: for each query the k-th best score so far; it is raised to that of this block.
    """
    if not len(q) or not len(x):
        return []
    order = np.argsort(x_ids, kind="stable")
    x_ids, x = x_ids[order], x[order]
    i, c, s = hits(q_ids, q, x_ids, x, k, np.full(len(q), -np.inf) if known is None else known, sides(q, True), sides(x, False))
    return list(zip(q_ids[i].tolist(), c.tolist(), s.tolist(), strict=True))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest of three types that keeps them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16) if most < 1 << 15 else x.astype(np.int32) if most < 1 << 31 else x


def widened(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(vectors) // (len(i) * dim)]
    return i, np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)


class Share:
    """The query blocks of one length that a task has, and the k best of each query so far."""

    def __init__(self, dim: int, k: int) -> None:
        self.dim, self.k, self.queries, self.best, self.least, self.waiting = dim, k, [], [], [], []

    def query(self, ids: bytes, vectors: bytes) -> None:
        none = np.empty(0, np.int64)
        self.queries.append((ids, vectors))
        self.best.append((none, none, none))
        self.least.append(np.full(len(ids) // 8, -np.inf))

    def candidates(self, ids: bytes, vectors: bytes) -> None:
        if self.queries:
            self.waiting.append((ids, vectors))
            if len(self.waiting) == SOME:
                self.compare()

    def compare(self) -> None:
        data = [(i, x, sides(x, False)) for i, x in (widened(*w, self.dim) for w in self.waiting)]
        self.waiting = []
        for b, block in enumerate(self.queries):
            q_ids, q = widened(*block, self.dim)
            q_sides, least = sides(q, True), self.least[b]
            for x_ids, x, x_sides in data:
                found = hits(q_ids, q, x_ids, x, self.k, least, q_sides, x_sides)
                if not len(found[0]):
                    continue
                i, c, s = self.best[b] = best_rows(*(np.concatenate(p) for p in zip(self.best[b], found, strict=True)), self.k)
                full = np.flatnonzero(np.bincount(i, minlength=len(q)) == self.k)
                last = np.searchsorted(i, full, side="right") - 1
                for r, t in zip(full.tolist(), s[last].tolist(), strict=True):
                    least[r] = max(least[r], below(t))

    def out(self) -> Iterator[pa.RecordBatch]:
        self.compare()
        for (ids, _), (i, c, s) in zip(self.queries, self.best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[i]), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])


def blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """dim, block, ids (int64 bytes, ascending), vectors (bytes of floor(scale * component), narrow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        made = (task.partitionId() if task else 0) << 33
        held: dict[int, list] = {}
        waiting = 0

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            waiting -= x.size
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            many = max(1, min(size, BLOCK_BYTES // (8 * dim)))
            for at in range(0, len(ids), many):
                order = at + np.argsort(ids[at : at + many], kind="stable")
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([made], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([narrow(x[order]).tobytes()], pa.binary())], names=["dim", "block", "ids", "vectors"])

        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("embedding")
            length, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(length) - length
            for dim in np.unique(length).tolist():
                own = np.flatnonzero(length == dim)
                many = max(1, min(size, BLOCK_BYTES // (8 * dim)))
                at = 0
                while at < len(own):  # a block is filled up before the next one
                    have = sum(len(i) for i, _ in held.get(dim, []))
                    part = own[at : at + many - have]
                    at += len(part)
                    held.setdefault(dim, []).append((ids[part], flat[starts[part][:, None] + np.arange(dim)]))
                    waiting += len(part) * dim
                    if have + len(part) == many:
                        yield from out(dim)
            if waiting > WAITING:  # of many lengths
                for dim in list(held):
                    yield from out(dim)
        for dim in list(held):
            yield from out(dim)

    return rows.mapInArrow(run, "dim int, block long, ids binary, vectors binary")


def tiles(parts: int, n: int, size: int, every: int, block: int) -> tuple[int, int]:
    """Groups of candidates and shares of queries, of n queries of `size` bytes as doubles: as many tasks as partitions, within COPIES and HELD."""
    shares = max(1, -(-size // HELD), min(COPIES, math.ceil(math.sqrt(parts / every))))
    groups = min(-(-parts // shares), every * shares, -(-n * every // block))  # no more than there are blocks, about
    return max(1, groups), shares


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_block: int = 1024, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    whole = lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) == float("inf"))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, whole), F.lit(True)))
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    chosen = written(rows.where(F.col("vec_id") % every == 0), "queries")
    n, size = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()
    queries = blocks(chosen.repartition(max(1, -(-n // query_block))), query_block, scale)
    groups, shares = tiles(int(spark.conf.get("spark.sql.shuffle.partitions")), n, size, every, block)
    # the k-th block of a partition goes k groups or shares on from where the partition starts
    turn = lambda many: F.pmod(F.col("block").bitwiseAND((1 << 33) - 1) + F.shiftright("block", 33), F.lit(many)).cast("int")
    row = [F.col("dim"), F.col("ids"), F.col("vectors")]
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), turn(shares).alias("share"), F.lit(0).alias("kind"), *row)
    data = blocks(rows, block, scale).select(turn(groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(1).alias("kind"), *row)
    dealt = asked.unionByName(data).withColumn("tile", (F.col("group") * shares + F.col("share")).cast("int")).drop("group", "share")
    dealt = dealt.repartitionById(groups * shares, "tile").sortWithinPartitions("tile", "dim", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, share = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                tile, dim, kind, ids, v = (batch.column(c)[r].as_py() for c in ("tile", "dim", "kind", "ids", "vectors"))
                if at != (tile, dim):
                    if share:
                        yield from share.out()
                    at, share = (tile, dim), Share(dim, k)
                (share.candidates if kind else share.query)(ids, v)
        if share:
            yield from share.out()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
