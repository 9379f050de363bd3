import random

import xxhash

from recollect.llm import queries, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low:
        if c in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    words += [cur] if cur else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: {key: (doc_id, fingerprint)}; smallest doc_id of each component of words within 2 bits."""
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 2:
                parent[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(fps[k][0])
    return {k: min((x for x in groups[find(k)] if x is not None), default=None) for k in keys}


def test_fingerprints():
    rng = random.Random(2)
    for text in [None, "", "  ", "One", "A b", "É a b c\x0bd", *[" ".join(rng.choices(["Ab", "c d", "x,", "YZ"], k=rng.randint(1, 40))) for _ in range(60)]]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(i, 64))


def test_query(spark, sf):
    docs = {i: (r["doc_id"], plain_fingerprint(r["text"])) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").collect())}
    comp = plain_components(docs)
    want = sorted((d, f"{fp:016x}", comp[i]) for i, (d, fp) in docs.items())
    assert sorted(map(tuple, queries.op7_simhash(spark, sf).collect())) == want


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BUCKET", 2)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b for x in base for b in [x] + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)]} | {rng.getrandbits(64) for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted(fps)
    pairs = simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    got = simhash.connected_components(pairs).collect()
    label = {r["node"]: r["component"] for r in got}
    comp = plain_components({f: (i, f) for i, f in enumerate(fps)})
    mine = {}
    for f in fps:
        mine.setdefault(label.get(signed(f), signed(f)), set()).add(f)
    want = {}
    for f in fps:
        want.setdefault(comp[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_odd(spark, odd):
    rows = simhash.simhash_components(odd("fp")).collect()
    assert len(rows) == 9
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert by[(3, 0)] == by[(2, 0)] == by[(5, 0)] == by[(None, 0)] == 2
    kept = simhash.keep_one(odd("fp"))
    assert kept.columns == odd("fp").columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6]
    assert simhash.simhash_components(odd(rows=[])).count() == 0
    alone = [(None, "some words without any id at all here", "en", "a", 1, "x"), (None, "quite different other words make this text", "en", "a", 1, "x")]
    assert simhash.keep_one(odd(rows=alone)).count() == 2
