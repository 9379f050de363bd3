"""Similarity search and joins that are exact and leave out what cannot count: cells around pivots, and prefixes of sparse vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import l2_normalise
from recollect.session import Cut

#: Pivots are taken from at most this many vectors, those whose ids hash lowest.
SAMPLE = 2048
#: A table has at most this many cells.
CELLS = 64
#: A task multiplies blocks of at most this many vectors of two cells.
BLOCK = 2048
#: Vectors with at most this share of numbers other than zero, on average, are joined by their terms.
SPARSE = 0.125
#: A task of a sparse join has about as many rows, or two blocks of as many rows of a frequent term.
MEETING = 2048
#: Their products are taken in tiles of as many rows, over sums of weights in so many places.
TILE, PLACES = 1024, 256
#: About as many numbers of pairs are held at once where pairs are looked at one by one.
PAIRS = 1 << 20
#: Distances are computed in floating point; bounds give way by this much.
SLACK = 1e-6


def pivots(vectors: DataFrame, id_col: str, vec: str, cells: int = CELLS) -> np.ndarray:
    """Up to ``cells`` unit vectors that lie far from each other, from a bounded sample; rows of one length only."""
    sample = vectors.select(F.col(vec).alias("v")).where(F.size("v") > 0).orderBy(F.xxhash64(id_col), F.col("v")).limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    x = np.array([r["v"] for r in sample], dtype=np.float64)
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(cells, math.ceil(math.sqrt(len(x)))) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    # two rounds of means, which lie nearer to the middle of what they stand for
    p = x[chosen]
    for _ in range(2):
        own = (x @ p.T).argmax(axis=1)
        p = np.stack([x[own == i].mean(axis=0) if (own == i).any() else p[i] for i in range(len(p))])
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
    return p


def nearest_points(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the distance from it."""
    cell = (x @ points.T - (points * points).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)
    return cell, np.linalg.norm(x - points[cell], axis=1)


def assigned(vectors: DataFrame, vec: str, points: np.ndarray) -> DataFrame:
    """``vectors`` with ``cell``, the nearest pivot, and ``away``, the distance from it; a vector without pivots is in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(vec)
            x = np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, points.shape[1]))
            cell, away = nearest_points(x, points) if len(x) else (np.zeros(0, np.int32), np.zeros(0))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    if not len(points):
        return vectors.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    kind = vectors.schema.simpleString()[len("struct<") : -1]
    return vectors.mapInArrow(run, f"{kind},cell:int,away:double")


# --- search -----------------------------------------------------------------------------------


def cell_table(placed: DataFrame, points: np.ndarray, by: str = "project") -> DataFrame:
    """``(by, cell, pivot, least, most, n)``: the cells of ``assigned`` vectors with their pivots, distances and sizes."""
    table = placed.sparkSession.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "cell int, pivot array<double>")
    sizes = placed.groupBy(by, "cell").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(table), "cell", "left").select(by, "cell", "pivot", "least", "most", "n")


def bounded(cells: DataFrame, query: list[float]) -> DataFrame:
    """``cells`` with ``bound``: no unit vector in the cell has a greater inner product with the unit query.

    The triangle inequality bounds the distance of its vectors from below by the pivot's and the cell's radii.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    apart = F.sqrt(F.aggregate(F.zip_with("pivot", q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    low = F.greatest(apart - F.col("most"), F.col("least") - apart, F.lit(0.0))
    return cells.withColumn("bound", F.when(F.col("pivot").isNull(), 1.0).otherwise(1 - low * low / 2) + SLACK)


def nearest_cells(cells: DataFrame, query: list[float], k: int, by: str = "project") -> DataFrame:
    """The cells to look at first: those of highest bound that hold k vectors together."""
    w = Window.partitionBy(by).orderBy(F.desc("bound"), "cell")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bounded(cells, query).withColumn("_before", before).where(F.col("_before") < k).select(by, "cell")


def of_cells(vectors: DataFrame, chosen: DataFrame, by: str = "project") -> DataFrame:
    """Vectors of the chosen cells, which are few; where vectors are partitioned by cell, others are not read."""
    return vectors.join(F.broadcast(chosen), [by, "cell"], "left_semi")


def search_cells(vectors: DataFrame, cells: DataFrame, query: list[float], k: int, score: Column, by: str = "project") -> tuple[DataFrame, DataFrame]:
    """``(vectors, cells)``: vectors that hold every project's k best by ``score``, and the cells they come from; exact.

    ``vectors`` are unit vectors partitioned by ``by`` and cell, ``cells`` their ``cell_table``, ``score`` is the inner product with
    the unit query. The cells that look best give a first list; its kth score rules out every cell whose bound is lower.
    """
    first = of_cells(vectors, nearest_cells(cells, query, k, by), by).select(by, score.alias("_s"))
    w = Window.partitionBy(by).orderBy(F.desc("_s"))
    ranked = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    # with fewer than k vectors in all, nothing is ruled out
    kth = ranked.groupBy(by).agg(F.when(F.count(F.lit(1)) == k, F.min("_s")).alias("_least"))
    judged = bounded(cells, query).join(kth, by, "left").select(by, "cell", "bound", F.coalesce("_least", F.lit(-2.0)).alias("_least"))
    # a condition beside the partitions' names, which lets Spark prune them before it reads
    chosen = Cut(judged, "judged").df.where(F.col("bound") >= F.col("_least")).select(by, "cell")
    return of_cells(vectors, chosen, by), chosen


# --- joins ------------------------------------------------------------------------------------


def _first(xo, xi, yo, yi):
    return (xo < yo) | ((xo == yo) & (xi < yi))


def _products(threshold: float):
    """Pairs over the threshold between the two sides of a task, or within the one that it has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64", "sim": "float64"})
        same = bool(pdf["same"].iloc[0])
        x, y = (pdf, pdf) if same else (pdf[pdf["left"]], pdf[~pdf["left"]])
        if not len(x) or not len(y):
            return none
        s = np.stack(x["vec"].to_numpy()) @ np.stack(y["vec"].to_numpy()).T
        r, c = np.nonzero(s >= threshold)
        xo, yo, xi, yi = x["ord"].to_numpy()[r], y["ord"].to_numpy()[c], x["id"].to_numpy()[r], y["id"].to_numpy()[c]
        before = _first(xo, xi, yo, yi)
        keep = (xi != yi) & (before if same else True)
        return pd.DataFrame({"a": np.where(before, xi, yi)[keep], "b": np.where(before, yi, xi)[keep], "sim": s[r, c][keep]})

    return run


def dense_pairs(rows: DataFrame, threshold: float, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """``(a, b, sim)`` of the pairs of unit vectors of one length within a project whose inner product reaches the threshold.

    Vectors lie in cells around pivots. Two cells meet only if their pivots are no farther apart than their radii and
    the threshold's distance allow, and a vector goes only to cells that it can reach; large cells meet in blocks.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    points = pivots(rows, "id", "vec", cells)
    placed = Cut(assigned(rows, "vec", points), "placed").df
    stats = placed.groupBy("project", "cell").agg(F.max("away").alias("most"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    apart = np.linalg.norm(points[:, None] - points[None], axis=2) if len(points) else np.zeros((1, 1))
    table = rows.sparkSession.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(apart)) for j in range(len(apart))], "cell int, other int, apart double")
    other = stats.select("project", F.col("cell").alias("other"), F.col("most").alias("other_most"), F.col("blocks").alias("other_blocks"))
    meet = stats.join(F.broadcast(table), "cell").join(other, ["project", "other"]).where(F.col("apart") <= F.col("most") + F.col("other_most") + reach)
    meet = meet.select("project", "cell", "other", "apart", "blocks", "other_most", "other_blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    at = placed.join(meet, ["project", "cell"]).where(F.col("apart") <= F.col("away") + F.col("other_most") + reach)
    at = at.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("own").alias("b")), F.struct(F.col("other").alias("c"), F.col("k").alias("b"))
    task = at.select("project", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), (mine <= theirs).alias("left"), (mine == theirs).alias("same"), "id", "ord", "vec")
    return task.groupBy("project", "i", "j").applyInPandas(_products(threshold), "a long, b long, sim double")


def _meetings(threshold: float):
    """Pairs over the threshold of rows that meet at a term, for the terms, or the two blocks of one term's rows, of a task.

    From the term on, absolute weights summed in ``PLACES`` places give products that no pair exceeds, a tile of rows at a time. Only
    pairs whose product reaches the threshold are looked at one by one: whether the term is the first they share, then their cosine.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        order = pc.sort_indices(t, [("head", "ascending"), ("own", "ascending")])
        t = t.take(order).combine_chunks()
        n, i, j = len(t), key[1].as_py(), key[2].as_py()
        head, own, place, total = (t.column(c).to_numpy() for c in ("head", "own", "place", "total"))
        rank = np.empty(n, dtype=np.int64)
        rank[pc.sort_indices(t.select(["ord", "id"]), [("ord", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(n)
        lists = t.column("at").combine_chunks()
        size = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        weight = t.column("weight").combine_chunks().flatten().to_numpy()
        # terms numbered from the most frequent on, which get places of their own
        _, code, many = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.empty(len(many), dtype=np.int32)
        number[np.argsort(-many, kind="stable")] = np.arange(len(many), dtype=np.int32)
        code = number[code]
        terms, weights = np.full((size.max(), n), -1, dtype=np.int32), np.zeros((size.max(), n))
        terms[col, row], weights[col, row] = code, weight
        ahead = np.where(np.arange(place.max())[:, None] < place, terms[: place.max()], -1)
        from_head = np.where(col >= place[row], np.abs(weight) / np.sqrt(total[row]), 0)
        most = np.bincount(row * PLACES + code % PLACES, weights=from_head, minlength=n * PLACES).reshape(n, PLACES).astype(np.float32)

        def judged(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The pairs of rows x and y that count, a bounded number at a time."""
            step = max(1, PAIRS // len(terms))
            for s in range(0, len(x), step):
                r, c = x[s : s + step], y[s : s + step]
                new = np.ones(len(r), dtype=bool)
                theirs = ahead[: place[c].max()][:, c]
                for mine in ahead[: place[r].max()]:
                    mine = mine[r]
                    for other in theirs:
                        new &= (mine != other) | (mine < 0)
                r, c = r[new], c[new]
                their_terms, their_weights, product = terms[:, c], weights[:, c], np.zeros(len(r))
                for mine, w in zip(terms, weights):
                    mine = mine[r]
                    same = their_terms == mine
                    same &= mine >= 0
                    product += w[r] * (their_weights * same).sum(axis=0)
                sim = product / np.sqrt(total[r] * total[c])
                keep = sim >= threshold
                r, c, sim = r[keep], c[keep], sim[keep]
                before = rank[r] < rank[c]
                a, b = np.where(before, r, c), np.where(before, c, r)
                if len(a):
                    ids = t.column("id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([t.column("project").combine_chunks().take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(sim)], names=["project", "a", "b", "sim"])

        def tiles() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of rows of one term that may count."""
            starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], n]):
                middle = end if i == j else start + int((own[start:end] == i).sum())
                for r in range(start, middle, TILE):
                    for c in range(r if i == j else middle, end, TILE):
                        x, y = slice(r, min(r + TILE, middle)), slice(c, min(c + TILE, end))
                        at, to = np.nonzero(most[x] @ most[y].T >= threshold - 1e-4)
                        at, to = at + r, to + c
                        yield (at[at < to], to[at < to]) if r == c else (at, to)

        held, n_held = [], 0
        for pair in tiles():
            held.append(pair)
            n_held += len(pair[0])
            if n_held >= PAIRS // len(terms):
                yield from judged(*(np.concatenate(p) for p in zip(*held)))
                held, n_held = [], 0
        if n_held:
            yield from judged(*(np.concatenate(p) for p in zip(*held)))

    return run


def sparse_pairs(entries: DataFrame, order: DataFrame, threshold: float, block: int = MEETING) -> DataFrame:
    """``(project, a, b, sim)``: pairs of rows within a project whose cosine reaches the threshold; a comes before b.

    ``entries(project, id, term, weight)`` are the numbers other than zero, ``order(project, id, ord)`` the rows. Terms are ordered from the
    rarest on. What follows a row's prefix is too short to reach the threshold, so two rows that do share a term of both
    prefixes: only these meet, at the first such term. Weights may be negative; cosines are inner products over the
    root of both rows' sums of squares.

    Rows go with their numbers to the terms of their prefixes and are compared there, so that only pairs that count leave a task. Rare
    terms share tasks; the rows of a frequent one meet in blocks.
    """
    entries = Cut(entries.where("weight <> 0"), "entries").df
    # numbered, as the numbers are shorter than the terms and as good to compare
    terms = entries.groupBy("project", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.monotonically_increasing_id())
    terms = Cut(terms, "terms").df
    row = Window.partitionBy("project", "id")
    square = F.col("weight") * F.col("weight")
    # from the most frequent term on, so that what follows a term is summed once
    rest = F.sum(square).over(row.orderBy(F.desc("n"), F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = entries.join(terms, ["project", "term"]).withColumns({"rest": rest, "total": F.sum(square).over(row)})
    # a term of one row only counts for its length
    shared = F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "at", "weight"))))
    prefix = F.count_if((F.col("n") > 1) & (F.col("rest") >= F.col("total") * (threshold * threshold - SLACK)))
    rows = ranked.groupBy("project", "id").agg(shared.alias("v"), prefix.cast("int").alias("prefix"), F.max("total").alias("total"))
    rows = rows.where("prefix > 0").join(order, ["project", "id"])
    rows = Cut(rows.select("project", "id", "ord", "prefix", "total", F.col("v.at").alias("at"), F.col("v.weight").alias("weight")), "vectors").df
    tasks = math.ceil((rows.agg(F.sum("prefix")).first()[0] or 0) / block) or 1
    heads = rows.select("project", "id", F.posexplode(F.slice("at", 1, F.col("prefix"))).alias("place", "head"))
    many = heads.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    task = F.when(F.col("blocks") > 1, F.col("head")).otherwise(-1 - F.pmod(F.xxhash64("head"), F.lit(tasks)))
    met = heads.join(many, "head").withColumns({"own": own, "task": task}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("project", "id", "head", "place", "own", "task", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    wide = met.join(rows.drop("prefix"), ["project", "id"])
    found = T.StructType([T.StructField("project", entries.schema["project"].dataType), *[T.StructField(c, entries.schema["id"].dataType) for c in "ab"], T.StructField("sim", T.DoubleType())])
    return wide.groupBy("task", "i", "j").applyInArrow(_meetings(threshold), found)


def near_pairs(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(a, b, sim)`` of all pairs within a project whose cosine is ``threshold`` or more; a comes before b by ``ord``.

    ``rows(project, id, ord, vec)``. Vectors that are mostly zeros meet by their rarest terms, others in cells around
    pivots; both are exact and find the same pairs. Only vectors of one length are compared; zero vectors match
    nothing, and a threshold of 0 or less has all pairs compared.
    """
    unit = Cut(rows.select("project", "id", "ord", l2_normalise(F.col("vec")).alias("vec")), "unit").df
    filled = F.size(F.filter("vec", lambda x: x != 0))
    sizes = {r["size"]: r["share"] for r in unit.where(filled > 0).groupBy(F.size("vec").alias("size")).agg(F.avg(filled / F.size("vec")).alias("share")).collect()}
    out = rows.sparkSession.createDataFrame([], "a long, b long, sim double")
    for size, share in sorted(sizes.items()):
        part = unit.where((F.size("vec") == size) & (filled > 0 if threshold > 0 else F.lit(True)))
        if share <= SPARSE and threshold > 0:
            entries = part.select("project", "id", F.posexplode("vec").alias("term", "weight"))
            out = out.unionByName(sparse_pairs(entries, part.select("project", "id", "ord"), threshold).drop("project"))
        else:
            out = out.unionByName(dense_pairs(part, threshold, block))
    return out
