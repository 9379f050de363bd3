import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import packing, queries
from recollect.llm.tokens import byte_bpe


def plain_best_fit(lengths, capacity):
    """Rooms of the bins, pieces one by one from the longest on, each into the tightest bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def filled(runs, counts):
    """(bin, offset, length) of every piece of the runs."""
    out = []
    for k, (length, rank, first, each, before) in enumerate(runs):
        later = [r[1] for r in runs if r[0] == length and r[1] > rank]
        for i in range((min(later) if later else counts[length]) - rank):
            out.append((first + i // each, before + i % each * length, length))
    return out


def test_runs_are_best_fit():
    rng = random.Random(3)
    for capacity in (1, 2, 7, 16, 40, 1024):
        for _ in range(12):
            lengths = [rng.randint(1, max(1, capacity - 1)) if rng.random() < 0.6 else min(3, max(1, capacity - 1)) for _ in range(rng.randint(0, 150))] if capacity > 1 else []
            counts = np.bincount(lengths, minlength=capacity).tolist() if lengths else [0] * capacity
            runs, bins = packing.best_fit(counts, capacity)
            rooms = plain_best_fit(lengths, capacity)
            got = filled(runs.tolist(), counts)
            used = {}
            for b, at, n in sorted(got):
                assert used.get(b, 0) == at  # gapless from 0
                used[b] = at + n
            assert sorted(n for _, _, n in got) == sorted(lengths)
            assert bins == len(rooms) and sorted(capacity - u for u in used.values()) == sorted(rooms)


def test_same_ids_by_both_libraries():
    bpe, rng = byte_bpe("byte_bpe_50k.json"), random.Random(5)
    alphabet = list("abcXYZ019 \n\t'sré日本́😀\x00\xa0　.,;-") + ["<|endoftext|>", "'re", "  ", "\r\n"]
    for _ in range(2000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert bpe.ids(text) == bpe.special.encode(text, add_special_tokens=False).ids
        assert bpe.ids(text, special=False) == bpe.plain.encode(text, add_special_tokens=False).ids
    assert len(bpe.ids(" " * 300000)) > 0  # the fast engine refuses this one
    assert b"".join(bpe.bytes_of()[i] for i in bpe.ids("é <|endoftext|> ﬁ")) == "é <|endoftext|> ﬁ".encode()


def check(rows, docs, capacity=1024):
    """rows: of the query; docs: (doc_id, text) without repeats. Pieces, digests and places against the tokenizer."""
    bpe = byte_bpe("byte_bpe_50k.json")
    want, short = [], []
    for d, text in docs:
        ids = np.array([*bpe.special.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, k, i, j - i, zlib.crc32(ids[i:j].tobytes())))
            short += [j - i] if j - i < capacity else []
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values(), default=0) <= capacity
    assert len(used) == len(plain_best_fit(short, capacity)) + len(want) - len(short)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(queries.op11_pack(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs])


def test_odd(spark, odd):
    made = packing.pack(odd("ids"))
    rows = made.withColumn("crc", F.crc32("ids")).select("doc_id", "piece", "start", "length", "crc", "sequence_id", "offset").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd().collect()])
    assert packing.pack(odd(rows=[])).count() == 0


@pytest.mark.parametrize("capacity", [8, 64])
def test_sequences(spark, odd, capacity):
    """Short sequences: many pieces; the sequences' ids are their pieces' in place."""
    packed = packing.pack(odd(), capacity).cache()
    rows = packed.collect()
    joined = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert len(joined) == len({r["sequence_id"] for r in rows})
    for s, r in joined.items():
        parts = sorted((p for p in rows if p["sequence_id"] == s), key=lambda p: p["offset"])
        assert bytes(r["ids"]) == b"".join(bytes(p["ids"]) for p in parts) and len(r["ids"]) == 4 * r["length"] <= 4 * capacity
        assert r["doc_ids"] == [p["doc_id"] for p in parts]
    packed.unpersist()


def test_hot_length(spark):
    """A third and more of all rows have one length: several shares, one packing."""
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, '', repeat('word ', cast(id % 300 as int))) as text")
    rows = packing.pack(docs, 256).withColumn("crc", F.crc32("ids")).select("doc_id", "piece", "start", "length", "crc", "sequence_id", "offset").collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 256)
