import random

import numpy as np
import pytest

from recollect.llm import decontam as D
from recollect.llm import queries


def plain_distance(a, b):
    """Fewest edits between a and any substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choices("ab ", k=rng.randint(10, 30)))
        b = list("".join(rng.choices("ab ", k=rng.randint(0, 20))) + a + "".join(rng.choices("ab ", k=rng.randint(0, 20))))
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice("abc")
        b = "".join(b)
        want = plain_distance(a, b)
        got, _ = D.banded_distance(a, b, -len(a), len(b), 4)
        assert got == min(want, 5)


def test_hashes():
    c = np.array([ord(x) for x in "abcdefghijklmnop"], dtype="<u4")
    h = D.qgram_hashes(c)
    assert len(h) == 16 - D.Q + 1
    m = int(D._MIX)
    assert int(h[0]) == sum(int(c[i]) * pow(m, D.Q - 1 - i, 1 << 64) for i in range(D.Q)) % (1 << 64)


def brute(docs, items):
    out = set()
    for d, t in docs:
        t = D.normalise(t)
        for i, b in items:
            b = D.normalise(b)
            if any(plain_distance(b[s:e], t) <= D.budget(e - s)[0] for s, e in D.segments(len(b))):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["on", "the", "er", "th", "nd", "tion", "ing", "at", "heed", "blor"]
    text = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 20, 40]))) for i in range(12)]
    docs = []
    for d in range(40):
        body = text(rng.randint(0, 60))
        if d % 2:
            part = rng.choice(items)[1]
            part = list(part)
            for _ in range(rng.choice([0, 1, 3, 6, 20])):
                part[rng.randrange(len(part))] = rng.choice("xyz ")
            body = body[: len(body) // 2] + " " + "".join(part).upper() + "!! " + body[len(body) // 2 :]
        docs.append((d, body))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute(docs, items)


def test_blocks(spark, monkeypatch):
    items = [(i, f"item number {i} " + "word%d " % i * 12) for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole and len(whole) >= 9


def test_query(spark, sf):
    rows = queries.op2_decontaminate(spark, sf).collect()
    docs = {r["doc_id"]: D.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: D.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in rows}


def test_odd(spark, odd):
    bench = spark.createDataFrame([(1, "Plain words stand here in one line"), (2, None), (3, ""), (None, "Plain words stand here"), (4, "tiny")], "item_id long, text string")
    hits = D.contaminated(odd("tk"), bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in hits) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1)]
    kept = D.decontaminate(odd("tk"), bench)
    assert kept.columns == odd("tk").columns and kept.count() == 6
    assert D.contaminated(odd(rows=[]), bench).count() == 0 and D.contaminated(odd(), bench.limit(0)).count() == 0


def test_excerpts_from_every_place(spark):
    rng = random.Random(7)
    item = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(40))
    cuts = [item[s : s + D.SEGMENT] for s in range(len(item) - D.SEGMENT + 1)]
    cuts = [(s, c) for s, c in enumerate(cuts) if c == c.strip()]
    cuts += [(s + 1000, c[:20] + "z" + c[21:50] + c[51:]) for s, c in cuts]
    docs = spark.createDataFrame([(s, f"words before {c} and after") for s, c in cuts], "doc_id long, text string")
    hits = D.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in hits) == sorted(s for s, _ in cuts)
    assert all(r["edits"] == (0 if r["doc_id"] < 1000 else 2) for r in hits if r["matches"] == 1)


def test_aligned():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choices("abc", k=60))
        b = list("".join(rng.choices("abc", k=rng.randint(0, 20))) + a + "".join(rng.choices("abc", k=rng.randint(0, 20))))
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice(["", "a", "bc"])
        b = "".join(b)
        starts = np.arange(0, 31, 6)
        edits, ends = D.aligned(D.codes(a), starts, 30, D.codes(b), -len(a), len(b), 4)
        assert [int(e) for e in edits] == [min(plain_distance(a[s : s + 30], b), 5) for s in starts]
        assert all(e > 4 or 0 <= at <= len(b) for e, at in zip(edits, ends))


@pytest.mark.parametrize("hits", [40, 2_000_000])
def test_bounded_hits_change_nothing(spark, monkeypatch, hits):
    """Templated items, runs of one letter, long items and texts: few shared q-grams at a time give what all at once give."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    stem = " ".join(word() for _ in range(12))
    items = [(i, f"{stem} {word()} {word()}") for i in range(12)] + [(50, "a" * 300), (51, " ".join(word() for _ in range(80))), (None, "null id " + " ".join(word() for _ in range(12)))]
    docs = [(0, stem), (1, "x " * 30 + items[3][1] + " y" * 40), (2, "a" * 700), (3, " ".join(word() for _ in range(60))), (4, "b " + items[13][1][100:260] + " c"), (5, "z" + items[14][1]), (None, items[5][1]), (7, None), (8, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "PIECE", 200)
    monkeypatch.setattr(D, "WINDOW", 100)
    index = D.Index(items)
    want = {}
    for n, (_, t) in enumerate(docs):
        for _, i, s, e, edits, found in index.hits([D.normalise(t)]):
            was = want.get((n, i), (s, e, edits, set()))
            want[n, i] = (min(s, was[0]), max(e, was[1]), min(edits, was[2]), was[3] | set(found.tolist()))
    monkeypatch.setattr(D, "HITS", hits)
    got = {}
    for n, i, s, e, edits, found in index.hits([D.normalise(t) for _, t in docs]):
        was = got.get((n, i), (s, e, edits, set()))
        got[n, i] = (min(s, was[0]), max(e, was[1]), min(edits, was[2]), was[3] | set(found.tolist()))
    assert got == want and {(1, 3), (2, 12), (4, 13), (5, 14), (6, 5)} <= got.keys()
    assert {(n, i) for n, i in got} == {(n, i) for n, (_, t) in enumerate(docs) for i, (_, x) in enumerate(items) if any(plain_distance(D.normalise(x)[s:e], D.normalise(t)) <= D.budget(e - s)[0] for s, e in D.segments(len(D.normalise(x))))}
    if hits > 40:
        monkeypatch.setattr(D, "BLOCK_CHARS", 150)
        monkeypatch.setattr(D, "BLOCKS", 2)
        assert {r["doc_id"] for r in D.decontaminate(d, b).collect()} == {d for n, (d, _) in enumerate(docs) if not any(k[0] == n for k in got)}
        assert {(r["doc_id"], r["item_id"], r["matches"]) for r in D.contaminated(d, b).collect()} == {(docs[n][0], items[i][0], len(v[3])) for (n, i), v in got.items()}


def test_short_items(spark):
    """Items too short for a q-gram count whole, between word ends; a word or two are no passage."""
    items = [(1, "7 x 8 = 56"), (2, "yes"), (3, "7 x 8 = 56"), (4, "a b c"), (5, "no way")]
    docs = [(1, "We know: 7 × 7... and 7 X 8 -- 56!"), (2, "17 x 8 = 56, 7 x 8 = 567"), (3, "yes, no way"), (4, "a b c"), (5, None), (6, "x a b c a b c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(d, b).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 1), (1, 3), (4, 4), (6, 4)] and all(r["edits"] == 0 for r in rows)
    text = D.normalise(docs[0][1])
    assert all(text[r["span_start"] : r["span_end"]] == "7 x 8 56" for r in rows if r["doc_id"] == 1)
    assert sorted(r["doc_id"] for r in D.decontaminate(d, b).collect()) == [2, 3, 5]
