import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from recollect.llm import align, queries
from recollect.llm.tokens import byte_bpe


def plain(docs):
    """Brute force over (doc_id, text): token bytes, common ends, counts of pairs by dictionary."""
    left = Tokenizer.from_file(path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    a_bytes = byte_bpe("byte_bpe_50k.json").bytes_of()

    def b_bytes(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    rows, count = [], Counter()
    for d, text in docs:
        a = b = []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            if not b"".join(a_bytes[i] for i in a) == b"".join(map(b_bytes, b)) == (" " + text).encode():
                a = b = []

        def ends(ids, size):
            out, at = [], 0
            for i in ids:
                at += size(i)
                out.append(at)
            return out

        ea, eb = ends(a, lambda i: len(a_bytes[i])), ends(b, lambda i: len(b_bytes(i)))
        both = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for e in both:
            part = [[], []]
            while i < len(a) and ea[i] <= e:
                part[0].append(str(a[i]))
                i += 1
            while j < len(b) and eb[j] <= e:
                part[1].append(str(b[j]))
                j += 1
            groups.append("|".join(map(",".join, part)))
        at_b = {e: i for i, e in zip(b, eb)}
        links = [(i, at_b[e]) for i, e in zip(a, ea) if e in at_b]
        count.update(links)
        rows.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return [(d, n, m, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest) for d, n, m, g, links, digest in rows]


def same(rows, docs):
    key = lambda t: tuple((x is None, x or "" if isinstance(x, str) else x or 0) for x in t)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(plain(docs), key=key)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    same(queries.op12_align(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in docs])


def digested(df):
    return [r.asDict() | {"groups_sha256": hashlib.sha256(r["groups"].encode()).hexdigest() if r["n_a"] else ""} for r in df.collect()]


def test_odd(spark, odd):
    extra = [(7, "a literal ▁ mark", "en", "a", 1, "x"), (8, "<s> <|endoftext|> <0x41> \x00\n  two", "en", "a", 1, "x"), (9, " " * 200000, "en", "a", 1, "x")]
    docs = odd("links").union(spark.createDataFrame(extra, odd("links").schema))
    rows = digested(align.align(docs))
    same(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["n_a"] for r in rows}[7] == 0 and {r["doc_id"]: r["n_a"] for r in rows}[8] > 0
    assert align.align(odd(rows=[])).count() == 0


@pytest.mark.parametrize("block,cell", [(64, 1 << 26), (1 << 19, 50)])
def test_blocks_and_cells(spark, monkeypatch, block, cell):
    """Links in many small blocks, and hot stripes dealt over many tasks, give the same sums."""
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "CELL", cell)
    rng = random.Random(8)
    words = "the and, naïve tokenizer über 12345 antidisestablishmentarianism 日本語 x".split()
    docs = [(i, "the end. " * 30 if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    rows = digested(align.align(spark.createDataFrame(docs, "doc_id long, text string")))
    same(rows, docs)


def test_vocabularies_too_large():
    with pytest.raises(ValueError):
        align.Stripes(1 << 20, 1 << 20)
