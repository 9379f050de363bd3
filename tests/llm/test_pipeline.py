import math
from collections import Counter

import corpus_pipeline
from recollect.llm import decontam
from test_linededup import brute
from test_mixing import plain_count
from test_simhash import plain_components, plain_fingerprint


def test_stages(spark, sf):
    """Each stage against a plain version of what it must do, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    bench = {r["item_id"]: decontam.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert {d for d, r in before.items() if any(c.isalpha() for c in r["text"] or "")} - set(after) == set()
        elif name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            # banding finds nearly all that comparing all lines finds, and nothing else goes
            want = brute([(d, r["text"]) for d, r in before.items()])
            gone = {d for d, t in want.items() if not t.strip() and before[d]["text"].strip()}
            differ = [d for d in want if (after[d]["text"] if d in after else "") != ("" if d in gone else want[d])]
            assert len(differ) <= 0.02 * len(before) and all(d in after and len(after[d]["text"]) >= len(want[d]) for d in differ)
            assert all(after[d]["text"] == before[d]["text"] for d in set(after) - set(differ) if want[d] == before[d]["text"])
        elif name == "near_dedup":
            comp = plain_components({d: (d, plain_fingerprint(r["text"])) for d, r in before.items()})
            assert set(after) == set(comp.values())
        elif name == "decontaminate":
            leaks = {d for d, r in before.items() if any(b in decontam.normalise(r["text"]) for b in bench.values())}
            assert not leaks & set(after) and len(set(before) - set(after) - leaks) <= 0.01 * len(before)
        elif name == "mix_sources":
            sizes = Counter(r["source"] for r in before.values())
            total = sum(math.sqrt(n) for n in sizes.values())
            rate = {c: math.sqrt(n) * len(before) / total / n for c, n in sizes.items()}
            copies = Counter(r["doc_id"] for r in out.collect())
            assert copies == {d: n for d, r in before.items() if (n := plain_count(rate[r["source"]], d))}
        if name != "mix_sources":
            assert out.columns == columns
        docs = out


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd(spark, odd, sf):
    """Nulls, empty and repeated rows, one stage after the other."""
    docs, ids = odd(), {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, docs, sf).cache()
        ids[name] = Counter(r["doc_id"] for r in out.collect())
        docs = out if name != "mix_sources" else docs
    # texts without a letter go first
    assert ids["language_id"] == {1: 2, None: 1, 4: 1, 6: 1}
    # the row without id comes last, so its copy of the line goes and nothing is left of it
    assert ids["line_dedup"] == {1: 2, 4: 1, 6: 1}
    assert ids["near_dedup"].keys() == ids["decontaminate"].keys() == {1, 4, 6}
    assert ids["mix_sources"].keys() <= {1, 4, 6}
