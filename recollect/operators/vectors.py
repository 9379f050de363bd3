"""Vector index and exact retrieval."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import dot, l2_normalise, node_text
from recollect.operators import similar
from recollect.session import Cut


@lru_cache(maxsize=1 << 16)
def _hashed(word: str, dim: int) -> tuple[int, float]:
    """The place of a word in lower case, and its sign."""
    h = int.from_bytes(hashlib.md5(word.strip("().,:;\"'!?").encode()).digest()[:8], "little")
    return h % dim, 1.0 if h >> 63 else -1.0


class HashedWords:
    """Offline embedder: signed counts of hashed words, so equal words give near vectors."""

    model, dim = "hashed-words", 256

    def vectors(self, texts: list[str]) -> np.ndarray:
        places, signs = [], []
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                at, sign = _hashed(w, self.dim)
                places.append(i * self.dim + at)
                signs.append(sign)
        out = np.bincount(np.array(places, dtype=np.int64), weights=signs, minlength=len(texts) * self.dim)
        return out.astype(np.float32).reshape(len(texts), self.dim)


def embedder(provider=None):
    """A function from a text Column to a vector Column; ``provider.vectors`` gets batches, then single texts where a batch fails."""
    provider = provider or HashedWords()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                got = list(provider.vectors(texts.tolist()))
                if len(got) != len(texts):
                    raise ValueError("a vector is missing")
            except Exception:
                got = [provider.vectors([t])[0] for t in texts]
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in got], index=texts.index)

    return embed


class Embedded:
    """Adds vectors to rows of texts: each distinct text is embedded once, and none whose vector is known.

    ``known(text, vec)`` holds vectors of the same model, as ``attach`` made them; a text may occur repeatedly. ``unit`` makes new
    vectors unit vectors. Texts meet their vectors by a join, so nothing is held in memory; a null text is an empty one.
    """

    def __init__(self, embed: Callable[[Column], Column], known: DataFrame | None = None, unit: bool = False):
        self.embed, self.known, self.unit = embed, known, unit

    def attach(self, rows: DataFrame, text: Column) -> DataFrame:
        """``rows`` with ``vec``, the vector of ``text``."""
        rows = rows.withColumn("_text", F.coalesce(text, F.lit("")))
        new = rows.select("_text").distinct()
        held = None
        if self.known is not None:
            held = self.known.groupBy(F.col("text").alias("_text")).agg(F.any_value("vec").alias("vec"))
            new = new.join(held, "_text", "left_anti")
        # written, so that no later stage asks the provider again
        made = new.withColumn("vec", self.embed(F.col("_text")))
        if self.unit:
            made = made.withColumn("vec", F.transform(l2_normalise(F.col("vec")), lambda x: x.cast("float")))
        made = Cut(made, "embedded").df
        return rows.join(made if held is None else made.unionByName(held), "_text").drop("_text")


def is_cheap(provider) -> bool:
    """Whether a text is embedded at less cost than a vector is looked up: the offline embedder, not what is built on it."""
    return type(provider) is HashedWords


def placed_index(items: DataFrame, provider) -> tuple[DataFrame, np.ndarray]:
    """``items`` with unit vectors of a cheap provider and their cells (see ``similar.assigned``) in one pass, and the pivots.

    Only texts go to Python. Pivots come from the sample that ``similar.pivots`` would take of all.
    """
    text = F.coalesce("text", F.lit(""))
    sample = items.select("pos", text.alias("text")).orderBy(F.xxhash64("pos"), "text").limit(similar.SAMPLE)
    none = np.zeros((0, 0))
    points = similar.pivots(sample.select("pos", _located(provider, none)(F.col("text"))["vec"].alias("vec")), "pos", "vec")
    rows = items.withColumn("_at", _located(provider, points)(text))
    rows = rows.select(*items.columns, *[F.col(f"_at.{c}") for c in ("vec", "cell", "away")])
    return rows.withColumn("dim", F.size("vec")).withColumn("model", F.lit(provider.model)), points


def _located(provider, points: np.ndarray):
    """A function from a text Column to its unit vector, nearest pivot and distance; without pivots these are 0."""

    @F.arrow_udf("struct<vec:array<float>,cell:int,away:double>")
    def located(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.asarray(provider.vectors(texts.to_pylist()), dtype=np.float64)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            unit = (x / np.where(norm == 0, 1.0, norm)).astype(np.float32)
            cell, away = similar.nearest_points(unit.astype(np.float64), points) if len(points) else (np.zeros(len(x), np.int32), np.zeros(len(x)))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(unit.ravel()))
            yield pa.StructArray.from_arrays([vec, pa.array(cell), pa.array(away)], names=["vec", "cell", "away"])

    return located


def index_items(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """All nodes and the facts with text, nodes first, with the ``text`` that is embedded of each."""
    none = F.lit(None)
    n = nodes.select(
        "project", F.col("ord").alias("pos"), F.lit("node").alias("kind"), "id", "name", "type", "description",
        node_text(F.col("name"), F.col("type"), F.col("description"), F.col("aliases"), F.col("facts")).alias("text"),
        none.cast("array<string>").alias("nodes"), F.slice("facts", 1, 6).alias("facts"), "sources", none.cast("string").alias("file"),
    )
    f = facts.where("text is not null and text <> ''").select(
        "project", (F.col("ord") + F.lit(1 << 62)).alias("pos"), F.lit("fact").alias("kind"), none.cast("string").alias("id"), none.cast("string").alias("name"), none.cast("string").alias("type"),
        none.cast("string").alias("description"), "text", "nodes", none.cast("array<string>").alias("facts"), none.cast("array<string>").alias("sources"), "file",
    )
    return n.unionByName(f)


def build_index(nodes: DataFrame, facts: DataFrame, embed, model: str = HashedWords.model, known: DataFrame | None = None) -> DataFrame:
    """Unit vectors of ``index_items``; ``known(text, vec)`` are vectors of an earlier index of the model."""
    rows = Embedded(embed, known, unit=True).attach(index_items(nodes, facts), F.col("text"))
    return rows.withColumn("dim", F.size("vec")).withColumn("model", F.lit(model))


def pool_size(k: int) -> int:
    """How many of each project's best items a search for k nodes and k facts chooses from."""
    return max(3 * k, 20)


def search(vectors: DataFrame, query: list[float], k: int = config.QUERY_K, project: str | None = None, model: str | None = None, decimals: int | None = 3) -> DataFrame:
    """Up to k nodes and k facts nearest to the query, of the best ``max(3k, 20)`` items of each project.

    The cut over both kinds belongs to the result: fewer than k of a kind may come back. Only vectors of the query's
    length, and model where given, are compared; facts of equal text count once, the best.
    """
    norm = math.sqrt(sum(float(x) * float(x) for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    rows = vectors.where(F.col("dim") == len(query))
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    scored = rows.withColumn("score", dot(F.col("vec"), q)).drop("vec")
    w = Window.partitionBy("project").orderBy(F.desc("score"), "pos")
    pool = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool_size(k))
    same = F.when(F.col("kind") == "fact", F.lower(F.trim("text"))).otherwise(F.concat_ws("\x1f", "project", "id"))
    best = Window.partitionBy("kind", same).orderBy(F.desc("score"), "project", "pos")
    once = pool.withColumn("_d", F.row_number().over(best)).where("_d = 1")
    kinds = Window.partitionBy("kind").orderBy(F.desc("score"), "project", "pos")
    out = once.withColumn("rank", F.row_number().over(kinds)).where(F.col("rank") <= k).drop("_r", "_d")
    return out.withColumn("score", F.round("score", decimals)) if decimals is not None else out


def nearest(rows: DataFrame, query: Column, id_col: str, vec_col: str, k: int) -> DataFrame:
    """The k rows of largest inner product with a query vector; one pass and a bounded top list per task."""
    return rows.select(id_col, dot(F.col(vec_col), query).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
