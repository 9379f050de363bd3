"""Exact search and joins against brute force, and what they leave out."""

import difflib
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions.text import dot
from recollect.operators import resolve, similar, vectors
from recollect.plans.queries import QUERIES
from recollect.session import Cut

SF = "/root/testdata/sf0.001"


def clustered(n, dim, centres, spread, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, projects=1):
    return spark.createDataFrame([(f"p{i % projects}", i, i, [float(v) for v in row]) for i, row in enumerate(x)], "project string, id long, ord long, vec array<double>")


class TestSearch:
    def run(self, spark, x, query, k, projects=2):
        rows = table(spark, x, projects)
        points = similar.pivots(rows, "id", "vec")
        placed = Cut(similar.assigned(rows, "vec", points), "test-cells", by=("project", "cell")).df
        cells = similar.cell_table(placed, points)
        found, chosen = similar.search_cells(placed, cells, [float(v) for v in query], k, dot(F.col("vec"), F.array(*[F.lit(float(v)) for v in query])))
        best = {}
        for r in found.select("project", "id").collect():
            best.setdefault(r["project"], []).append(r["id"])
        for p, ids in best.items():
            mine = [i for i in range(len(x)) if f"p{i % projects}" == p]
            want = sorted(mine, key=lambda i: -x[i] @ query)[:k]
            assert set(want) <= set(ids)
        assert len(best) == projects
        return found, chosen.count(), cells.count()

    def test_clustered(self, spark):
        x = clustered(3000, 32, 40, 0.05)
        found, read, cells = self.run(spark, x, x[7], 20)
        assert read < cells / 3
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()

    def test_shapeless(self, spark):
        """Vectors without any clusters: all cells may count, and the result is exact all the same."""
        x = clustered(400, 8, 400, 1.0)
        self.run(spark, x, x[3], 5)

    def test_few_equal_and_zero(self, spark):
        x = np.concatenate([np.tile(clustered(1, 4, 1, 0), (30, 1)), np.zeros((3, 4))])
        self.run(spark, x, x[0], 20, projects=1)
        self.run(spark, x[:2], x[0], 20, projects=1)


def most_rows(df):
    """The most rows that an operator of a plan that has run gave."""

    def of(plan):
        metrics = plan.metrics()
        yield metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        for child in inner:
            yield from of(child)

    return max(of(df._jdf.queryExecution().executedPlan()))


def plain_pairs(x, threshold, projects=1):
    s = x @ x.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if i % projects == j % projects and s[i, j] >= threshold}


class TestPairs:
    @pytest.mark.parametrize("threshold", [0.5, 0.9, 0.0, -1.0])
    def test_dense(self, spark, threshold):
        x = clustered(300, 16, 12, 0.1)
        got = similar.near_pairs(table(spark, x, 2), threshold, block=40).collect()
        assert {(r["a"], r["b"]) for r in got} == plain_pairs(x, threshold, 2) and len(got) == len(plain_pairs(x, threshold, 2))

    def test_cells_that_cannot_meet_do_not(self, spark, monkeypatch):
        """The rows that reach the products grow with the clusters, not with the table."""
        x = clustered(2000, 32, 40, 0.02)
        seen = []
        products = similar._products

        def watched(threshold):
            seen.append(threshold)
            return products(threshold)

        monkeypatch.setattr(similar, "_products", watched)
        rows = table(spark, x)
        points = similar.pivots(rows, "id", "vec")
        assert len(points) > 20
        got = similar.dense_pairs(rows, 0.95)
        plan = got._jdf.queryExecution().logical().toString()
        assert "CartesianProduct" not in plan and seen == [0.95]
        assert {(r["a"], r["b"]) for r in got.collect()} == plain_pairs(x, 0.95)

    @pytest.mark.parametrize("threshold", [0.3, 0.7, 0.99])
    def test_sparse(self, spark, threshold):
        rng = random.Random(4)
        x = np.zeros((250, 128))
        for row in x:
            for t in rng.choices(range(128), weights=[1 / (i + 1) for i in range(128)], k=rng.randint(1, 8)):
                row[t] += rng.choice([1, 1, 2, -1])
        x = x[np.linalg.norm(x, axis=1) > 0]
        x[5] = x[6] = x[7]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = similar.near_pairs(table(spark, x, 2), threshold).collect()
        want = plain_pairs(unit, threshold, 2)
        near = {p for p in want ^ {(r["a"], r["b"]) for r in got} if abs(unit[p[0]] @ unit[p[1]] - threshold) > 1e-9}
        assert not near and len(got) == len({(r["a"], r["b"]) for r in got})

    @pytest.mark.parametrize("block, tile", [(7, 1024), (4096, 5), (30, 4)])
    def test_sparse_blocks(self, spark, monkeypatch, block, tile):
        """Rows of frequent terms meet in blocks and tiles, those of rare ones together; ids may be texts and repeat in projects."""
        monkeypatch.setattr(similar, "TILE", tile)
        rng = random.Random(5)
        rows, entries = [], []
        for i in range(240):
            project, id_ = f"p{i % 3}", f"r{i // 3 * 7 % 80}"
            words = {("common", f"group{i % 4}"): 1.0, ("own", f"{i}"): 0.5} | {("w", str(rng.randrange(12))): rng.choice([1.0, -1.0, 2.5]) for _ in range(4)}
            rows.append((project, id_, i % 5))
            entries += [(project, id_, "-".join(t), w) for t, w in words.items()]
        vec = {}
        for p, i, t, w in entries:
            vec.setdefault((p, i), {})[t] = w
        norm = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vec.items()}
        want = {}
        for p, i, o in rows:
            for q, j, u in rows:
                if p == q and (o, i) < (u, j):
                    sim = sum(w * vec[q, j].get(t, 0) for t, w in vec[p, i].items()) / norm[p, i] / norm[q, j]
                    if sim >= 0.7:
                        want[p, i, j] = sim
        got = similar.sparse_pairs(spark.createDataFrame(entries, "project string, id string, term string, weight double"), spark.createDataFrame(rows, "project string, id string, ord int"), 0.7, block=block).collect()
        assert len(got) == len(want) > 50 and all(math.isclose(want[r["project"], r["a"], r["b"]], r["sim"]) for r in got)

    def test_only_pairs_that_count_leave_a_sparse_task(self, spark):
        """Rows that share a frequent word and nothing else meet without a row for each pair, which would fill disks."""
        entries = [("p", i, t, 1.0) for i in range(1500) for t in ("all", f"a{i // 2}", f"b{i // 3}")]
        rows = spark.createDataFrame([("p", i, i) for i in range(1500)], "project string, id long, ord long")
        # all meet at the common word, but few share another one
        got = similar.sparse_pairs(spark.createDataFrame(entries, "project string, id long, term string, weight double"), rows, 0.5)
        found = got.collect()
        assert {(r["a"], r["b"]) for r in found} == {(i, j) for i in range(1500) for j in range(i + 1, min(i + 3, 1500)) if i // 2 == j // 2 or i // 3 == j // 3}
        assert most_rows(got) < 10 * len(entries)

    def test_odd(self, spark):
        rows = spark.createDataFrame([("p", 1, 1, [1.0, 0.0]), ("p", 2, 1, [1.0, 0.0]), ("p", 3, 0, [1.0, 0.0, 0.0]), ("p", 4, 0, [0.0, 0.0]), ("p", 5, 0, []), ("p", 6, 0, None), ("q", 7, 0, [1.0, 0.0])], "project string, id long, ord long, vec array<double>")
        assert [tuple(r) for r in similar.near_pairs(rows, 0.8).collect()] == [(1, 2, 1.0)]
        assert similar.near_pairs(rows.limit(0), 0.8).count() == 0


def test_merged_titles(spark):
    """The query against a plain version: hashed words, cosine, likeness, components, the most mentioned as representative."""
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    mentions = {}
    for d, text in docs:
        name = " ".join((text or "").split()[: 5 + d % 3]).strip(" \"'`*_#")
        key = " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in name.lower()).split())
        if key and not key.startswith("recollect"):
            mentions.setdefault(key, []).append((d, name, "Document" if d % 7 == 0 else "Concept"))
    vecs, top = {}, {}
    for key, rows in mentions.items():
        kinds = {}
        for d, _, t in rows:
            kinds.setdefault(t, []).append(d)
        top[key] = min(kinds, key=lambda t: (-len(kinds[t]), min(kinds[t])))
        v = np.zeros(256)
        for w in f"{rows[0][1]} ({top[key]})".lower().split():
            h = int.from_bytes(hashlib.md5(w.strip("().,:;\"'!?").encode()).digest()[:8], "little")
            v[h % 256] += 1 if h >> 63 else -1
        vecs[key] = v / (np.linalg.norm(v) or 1)
    keys = sorted(mentions, key=lambda k: mentions[k][0][0])
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = mentions[a][0][1].lower(), mentions[b][0][1].lower()
            if vecs[a] @ vecs[b] >= 0.86 and (x in y or y in x or difflib.SequenceMatcher(None, x, y).ratio() >= 0.5):
                parent[root(b)] = root(a)
    groups = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    assert any(len(g) > 1 for g in groups.values())
    want = set()
    for g in groups.values():
        best = min(g, key=lambda k: (-len(mentions[k]), mentions[k][0][0]))
        want.add((min(mentions[k][0][0] for k in g), mentions[best][0][1], sum(len(mentions[k]) for k in g), "|".join(sorted(mentions[k][0][1] for k in g if k != best)[:8])))
    got = {(r["ord"], r["name"], r["mentions"], r["aliases"]) for r in QUERIES["merged_titles"](spark, SF).collect()}
    assert got == want


def test_merged_titles_split_beginnings_only(spark, monkeypatch):
    """Of long texts no more than the words of a name are split, and once a text."""
    seen = []
    monkeypatch.setattr(resolve, "resolve", lambda raw, embed: seen.append(raw) or (raw.selectExpr("project id", "seq ord", "name", "type", "1L mentions", "aliases"), None))
    QUERIES["merged_titles"](spark, SF)
    plan = resolve.mentions_of(seen[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_extract(text") == 1 and "split(text" not in plan


def test_norms_are_computed_once(spark):
    """Unit vectors of 512 dimensions in well under a millisecond each."""
    import time

    from recollect.functions.text import l2_normalise

    rows = spark.range(0, 4000, 1, 4).select(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: (F.col("id") * 31 + i * 7) % 101 - 50.0).alias("v"))
    rows = Cut(rows, "wide").df
    began = time.time()
    total = rows.select(F.aggregate(l2_normalise(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.sum("n")).first()[0]
    assert math.isclose(total, 4000, rel_tol=1e-9) and (time.time() - began) * 4 / 4000 < 0.004


def test_pool():
    assert vectors.pool_size(8) == 24 and vectors.pool_size(2) == 20
