"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import Cut

#: Mean number of queries in a block; a block (some 12 MB) is broadcast and all rows are scored against it, TILE queries at a time.
BLOCK, TILE = 12_000, 1500
#: Bins of a histogram; each round narrows a query's interval by this factor.
BINS = 256
#: Rows scored at a time.
ROWS = 512
#: Scores are held to 64 bits, less the least value, which marks a query's own rows.
_NONE, _MOST = -(1 << 63), (1 << 63) - 1
_FLIP = np.uint64(1 << 63)


def _quantised(column: pa.Array, scale: float):
    """Yield (row numbers, matrix of floor(scale * x)) for each vector length; unusable vectors are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = np.asarray(column.is_valid())
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = column.values
    flat = np.asarray(values.cast(pa.float64()).fill_null(math.nan), dtype=np.float64)
    lengths = np.diff(offsets)
    for size in np.unique(lengths[ok]):
        rows = np.nonzero(ok & (lengths == size))[0]
        m = flat[offsets[rows][:, None] + np.arange(size)[None, :]]
        fine = np.isfinite(m).all(axis=1)
        yield rows[fine], np.floor(scale * m[fine])


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: float64 where they fit 53 bits, else Python integers held to 64 bits."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    qm, cm = np.abs(q).max(axis=1), np.abs(c).max(axis=1)
    fits = 2.0**53 / q.shape[1]
    if float(qm.max()) * float(cm.max()) < fits:
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), dtype=np.int64)
    wide_q, wide_c = qm * float(cm.min()) >= fits, cm * float(qm.min()) >= fits
    few_q, few_c = np.nonzero(~wide_q)[0], np.nonzero(~wide_c)[0]
    if len(few_q) and len(few_c) and float(qm[few_q].max()) * float(cm[few_c].max()) < fits:
        out[np.ix_(few_q, few_c)] = (q[few_q] @ c[few_c].T).astype(np.int64)
    else:
        wide_q[:] = True
    big = np.vectorize(int, otypes=[object])
    held = lambda s: np.clip(s, -_MOST, _MOST).astype(np.int64)
    if wide_q.any():
        out[wide_q] = held(big(q[wide_q]) @ big(c).T)
    if wide_c.any() and not wide_q.all():
        out[np.ix_(~wide_q, wide_c)] = held(big(q[~wide_q]) @ big(c[wide_c]).T)
    return out


def _order(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers of the same order, whose differences never overflow."""
    return scores.view(np.uint64) ^ _FLIP


class _Block:
    """Queries of a block by vector length: ids ascending and quantised vectors."""

    def __init__(self, rows: list, scale: float):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        if rows:
            for at, m in _quantised(pa.array([r[1] for r in rows], pa.list_(pa.float64())), scale):
                self.parts[m.shape[1]] = (at, self.ids[at], m)

    def scored(self, batches, scale: float):
        """(query numbers, row ids, scores); a query's own rows score _NONE."""
        for batch in batches:
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            for rows, m in _quantised(batch.column("vec"), scale):
                if m.shape[1] not in self.parts:
                    continue
                for t in range(0, len(self.parts[m.shape[1]][0]), TILE):
                    at, qid, q = (x[t : t + TILE] for x in self.parts[m.shape[1]])
                    for lo in range(0, len(rows), ROWS):
                        cid = ids[rows[lo : lo + ROWS]]
                        s = _scores(q, m[lo : lo + ROWS])
                        own = np.minimum(np.searchsorted(qid, cid), len(qid) - 1)
                        same = np.nonzero(qid[own] == cid)[0]
                        s[own[same], same] = _NONE
                        yield at, cid, s


def _histogram(block, low, high, width, k, scale):
    def run(batches):
        b, n = block.value, len(block.value.ids)
        counts = np.zeros((n, BINS), dtype=np.int64)
        for at, _, s in b.scored(batches, scale):
            u = _order(s)
            # the last bin may reach beyond the interval, where scores are already counted
            q, c = np.nonzero((u >= low[at][:, None]) & (u <= high[at][:, None]))
            bins = ((u[q, c] - low[at[q]]) // width[at[q]]).astype(np.int64)
            counts += np.bincount(at[q] * BINS + bins, minlength=n * BINS).reshape(n, BINS)
        # a bin below the kth largest score of this partition cannot hold the kth of all
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, c = np.nonzero((counts > 0) & (above < k))
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(counts[q, c])], names=["q", "bin", "n"])

    return run


def _best(q, ids, s, k):
    """The k best rows of each query by (score descending, id)."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.r_[0, np.nonzero(np.diff(q))[0] + 1] if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], ids[rank < k], s[rank < k]


def _chosen(block, floor, k, scale):
    def run(batches):
        b, held, size = block.value, [], 0
        for at, cid, s in b.scored(batches, scale):
            q, c = np.nonzero((_order(s) >= floor[at][:, None]) & (s != _NONE))
            held.append((at[q], cid[c], s[q, c]))
            size += len(q)
            if size > 1_000_000:
                held = [_best(*map(np.concatenate, zip(*held)), k)]
                size = len(held[0][0])
        q, ids, s = _best(*map(np.concatenate, zip(*held)), k) if held else (np.zeros(0, np.int64),) * 3
        yield pa.record_batch([pa.array(b.ids[q]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _norm(scale):
    def run(batches):
        most: dict[int, float] = {}
        for batch in batches:
            for _, m in _quantised(batch.column("vec"), scale):
                if len(m):
                    most[m.shape[1]] = max(most.get(m.shape[1], 0.0), float(np.sqrt((m * m).sum(axis=1)).max()))
        yield pa.record_batch([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.float64())], names=["size", "norm"])

    return run


def exact_topk(vectors: DataFrame, query_rows, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest integer inner product for each query.

    ``query_rows`` is a predicate over ``vectors`` that names the queries. They
    are taken in blocks of about BLOCK; for each block every row is scored,
    histograms of the scores narrow each query's interval until the bin of its
    kth largest value is one score wide or holds few rows, and a last pass
    keeps the rows at or above that bin, best k per partition and then per
    query, ties to the smaller id. A block costs three or four passes of
    matrix products over the rows; only histograms (BINS counts a query) reach
    the driver, and only k rows per query and partition are shuffled.

    Rows with a null id, a null vector or null or non-finite components take
    no part. Vectors of another length than the query's are not its candidates.
    Scores beyond 64 bits count as the greatest or least long. A query's candidates exclude all rows with its id; of several query rows with one
    id the smallest vector asks. Rows repeated under one id are ranked each. Fewer than k candidates give
    fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), query_rows.alias("asks")).where(
        "id is not null and vec is not null"
    )
    usable = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = Cut(base.where("asks").where(usable).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    rows = base.select("id", "vec")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    norms = {r["size"]: r["norm"] for r in rows.mapInArrow(_norm(scale), "size int, norm double").groupBy("size").agg(F.max("norm").alias("norm")).collect()}
    found = []
    for i in range(blocks):
        part = asked.df.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect() if blocks > 1 else asked.df.collect()
        block = _Block([(r["id"], r["vec"]) for r in part], scale)
        n = len(block.ids)
        if not n:
            continue
        shared = spark.sparkContext.broadcast(block)
        # intervals in the order of ``_order``, both ends included
        low, high, above = np.ones(n, np.uint64), np.full(n, ~np.uint64(0)), np.zeros(n, np.int64)
        for size, (at, _, q) in block.parts.items():
            reach = np.sqrt((q * q).sum(axis=1)) * norms.get(size, 0.0) * (1 + 1e-9) + 1
            near = reach < 2.0**62  # others may hold any score
            far = np.where(near, reach, 0.0).astype(np.uint64)
            low[at], high[at] = np.where(near, _FLIP - far, low[at]), np.where(near, _FLIP + far, high[at])
        wide = lambda: (high - low) // np.uint64(BINS) + np.uint64(1)
        width, floor, open_ = wide(), low.copy(), np.ones(n, dtype=bool)
        while open_.any():
            top = np.where(open_, high, np.uint64(0))  # settled queries count nothing more
            got = rows.mapInArrow(_histogram(shared, low, top, width, k, scale), "q int, bin int, n long")
            got = got.groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
            counts = np.zeros((n, BINS), dtype=np.int64)
            counts[np.asarray(got["q"]), np.asarray(got["bin"])] = np.asarray(got["n"])
            upto = above[:, None] + np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            enough = upto >= k
            bin_ = np.where(enough.any(axis=1), BINS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
            here = np.arange(n)
            within = upto[here, bin_]
            lower = low + bin_.astype(np.uint64) * width
            floor = np.where(open_, lower, floor)
            settled = (width == 1) | (within <= 4 * k) | ~enough.any(axis=1)
            above = np.where(open_, within - counts[here, bin_], above)
            high = np.where(open_, lower + np.minimum(width - np.uint64(1), high - lower), high)
            low = np.where(open_, lower, low)
            width = np.where(open_ & ~settled, wide(), width)
            open_ &= ~settled
        best = rows.mapInArrow(_chosen(shared, floor, k, scale), "query_id long, vec_id long, score long")
        found.append(Cut(best, "topk").path)
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema("query_id long, vec_id long, score long").parquet(*found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: DuckDB's form of the query over embeddings.
TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
