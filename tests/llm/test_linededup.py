import random

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import linededup as L
from recollect.llm import queries


def brute(docs):
    """Texts after dedup, by comparing all lines with each other; docs are (doc_id, text) with distinct ids."""
    occ = [(d, i, x) for d, t in docs for i, x in L.normal_lines(t)]
    lines = sorted({x for _, _, x in occ})
    sets = [L.shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if min(len(lines[i]), len(lines[j])) >= L.MIN_CHARS and len(sets[i] & sets[j]) >= L.THRESHOLD * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    place = {x: find(i) for i, x in enumerate(lines)}
    best = {}
    for d, i, x in occ:
        best[place[x]] = min(best.get(place[x], (d, i)), (d, i))
    gone = {(d, i) for d, i, x in occ if best[place[x]] != (d, i)}
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in queries.op4_line_dedup(spark, sf).collect()}
    want = brute(docs)
    differ = [d for d in want if got[d] != want[d]]
    # banding finds nearly all links of brute force, and none that it lacks
    assert len(differ) <= 0.02 * len(docs)
    for d in differ:
        assert len(got[d]) >= len(want[d])


@pytest.mark.parametrize("deep", [64, 2])
def test_near_copies_in_large_groups(spark, monkeypatch, deep):
    """Buckets of many blocks, of cells, and of keys dealt over several tasks."""
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "DEEP", deep)
    monkeypatch.setattr(L, "SPREAD", 10)
    monkeypatch.setattr(L, "HOT", 20)
    rng = random.Random(3)
    vocabulary = ["%s%s" % (a, b) for a in ("ka", "lo", "mi", "ru", "te", "su") for b in ("ban", "dor", "fel", "gim", "hut")]
    base = [rng.choice(vocabulary) for _ in range(24)]
    docs = []
    for d in range(80):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((d, " ".join(words) + "\nshort\n" + " ".join(rng.choices(vocabulary, k=20))))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert sum(got[d] != want[d] for d in want) <= 3


def linked_in_bucket(spark, lines, deep, monkeypatch):
    """Links that the second look finds among lines of one bucket, each a component of its own."""
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "DEEP", deep)
    rows, n = list(enumerate(lines)), len(lines)
    members = spark.createDataFrame([(0, i, i) for i, _ in rows], "rep long, lh long, c long")
    per = members.groupBy("rep").agg(L.F.min("c").alias("main"), L.F.count("*").alias("all"))
    blocks = lambda c: L.F.ceil(c / L.BLOCK).cast("int")
    main = per.select("rep", "main", "all", (L.F.col("all") - 1).alias("others"), blocks(L.F.col("all") - 1).alias("ni"), blocks(L.F.col("all")).alias("nj"))
    text = spark.createDataFrame(rows, "lh long, line string")
    hot = spark.createDataFrame([], "rep long, _parts int")
    found = {tuple(r) for r in L._blocks(members, main, text, hot).mapInArrow(L._second, "src long, dst long").collect()}
    return found, {(i, j) for j in range(n) for i in range(j) if L.jaccard(lines[i], lines[j]) >= L.THRESHOLD}


@pytest.mark.parametrize("kind", ["sparse", "dense"])
@pytest.mark.parametrize("deep", [1, 1000])
def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, deep, kind):
    """Lines near the threshold: large buckets find every link that small ones find, by cells or whole where cells are dearer."""
    rng, lines = random.Random(8), []
    for _ in range(40 if kind == "sparse" else 1):
        base = [rng.choice("abcdefghij語é") for _ in range(120)]
        for _ in range(4 if kind == "sparse" else 120):
            line = list(base)
            for _ in range(rng.choice([1, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("xyzä文")
            lines.append("".join(line))
    found, want = linked_in_bucket(spark, lines, deep, monkeypatch)
    assert len(want) > 100 and found == want


@pytest.mark.parametrize("n,letters", [(60, "abcde"), (300, "abcde"), (60, "ab語の本")])
def test_block_links_match_jaccard(n, letters, monkeypatch):
    monkeypatch.setattr(L, "COLUMNS", 100)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(letters, k=4))
    base, pool = [word() for _ in range(20)], [word() for _ in range(3)]
    lines = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(4)] = rng.choice(pool)
        lines.append((i, i, " ".join(w)))
    rest = lines[: n // 2]
    got = set(L.block_links(rest, lines))
    want = {(min(i, j), max(i, j)) for i, _, x in rest for j, _, y in lines if i != j and L.jaccard(x, y) >= L.THRESHOLD}
    assert want and got == want


def test_verified_matches_jaccard():
    rng, pairs = random.Random(6), []
    for _ in range(3000):
        a = "".join(rng.choices("abcdefgh ", k=rng.randrange(20, 120))) if rng.random() < 0.7 else "".join(rng.choices("ab語", k=rng.randrange(20, 60)))
        b = list(a)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1, 1, 5])] = rng.choices("abcxyz語", k=rng.choice([0, 1, 1, 4]))
        if len(b) >= L.MIN_CHARS:
            pairs += [(a, "".join(b)), ("".join(b), a)]
    batch = pa.RecordBatch.from_pylist([{"src": i, "dst": i, "a_line": a, "b_line": b} for i, (a, b) in enumerate(pairs)])
    got = {r["src"] for out in L._verified([batch]) for r in out.to_pylist()}
    want = {i for i, (a, b) in enumerate(pairs) if L.jaccard(a, b) >= L.THRESHOLD}
    assert got == want and 1000 < len(want) < len(pairs) - 1000


def test_bands_recall():
    rng = random.Random(5)
    hit = total = 0
    for _ in range(300):
        a = "".join(rng.choices("abcdefgh ", k=200))
        b = list(a)
        for _ in range(3):
            b[rng.randrange(200)] = rng.choice("xyz")
        b = "".join(b)
        if L.jaccard(a, b) >= L.THRESHOLD:
            x, y = L.band_keys([a, b])
            total += 1
            hit += bool(np.any(x == y))
    assert total > 200 and hit / total >= 0.97


def test_odd(spark, odd):
    out = L.dedup_lines(odd("n_lines"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]
    rows = sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)
    line = "Plain words stand here in one line and more words follow them."
    assert [r for r in rows if r[0] == 1] == [(1, line, 1, 0)] * 2
    assert (None, "", 1, 1) in rows and (3, None, 0, 0) in rows and (5, "\n\n \t\n", 4, 0) in rows
    assert L.dedup_lines(odd(rows=[])).count() == 0
    inside = [(9, "the very same line twice here\nthe  very SAME line twice here\nx", "en", "a", 1, "x")]
    assert L.dedup_lines(odd(rows=inside)).first()["text"] == "the very same line twice here\nx"
    short = [(2, "Yes.\nno\n\nb", "en", "a", 1, "x"), (1, "yes.\n\n\nNO \nyes", "en", "a", 1, "x")]
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(odd(rows=short)).collect()} == {1: "yes.\n\n\nNO \nyes", 2: "\nb"}
    long = [(1, "ab cd " * 50000 + "\nx", "en", "a", 1, "x"), (2, "ab cd " * 50000 + "y\nz", "en", "a", 1, "x")]
    assert {r["doc_id"]: r["text"][-3:] for r in L.dedup_lines(odd(rows=long)).collect()} == {1: "d \nx"[-3:], 2: "z"}
