import hashlib
import math

from recollect.llm import mixing, queries


def test_oracle(spark, sf, oracle):
    got = sorted((r.asDict() for r in queries.op1_mix_sources(spark, sf).collect()), key=repr)
    want = oracle(queries.oracle_sql()["op1_mix_sources"])
    assert sorted((sorted(r.items()) for r in got), key=repr) == sorted((sorted(r.items()) for r in want), key=repr)


def test_rates_and_counts(spark):
    docs = spark.createDataFrame([(i, "t", "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"a": 1.0, "b": 1.0}).collect()
    n = {s: sum(r["source"] == s for r in out) for s in "ab"}
    assert abs(n["a"] - 2000) < 5 * math.sqrt(2000) and abs(n["b"] - 2000) < 5 * math.sqrt(2000)
    per = {}
    for r in out:
        per.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in per.values())
    zero = sum(1 for i in range(0, 4000, 4) if i not in per) / 1000
    assert abs(zero - math.exp(-2)) < 0.05
    again = mixing.mix(docs.repartition(7), {"a": 1.0, "b": 1.0}).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def plain_count(rate, *who):
    """The operator's draw in Python."""

    def draw(r, *parts):
        u = (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        p = cdf = math.exp(-r)
        k = 0
        while cdf <= u and k < int(r + 12 * math.sqrt(r) + 40):
            k += 1
            p *= r / k
            cdf += p
        return k

    parts = math.ceil(rate / mixing.MOST_RATE)
    return sum(draw(rate / parts, 17, *who, i) for i in range(1, parts + 1)) if parts > 1 else draw(rate, 17, *who)


def test_against_plain_draws(spark):
    """Rates below and above what is drawn at once, null ids by text."""
    docs = [(i, "t", "a") for i in range(300)] + [(None, f"x{i}", "a") for i in range(100)] + [(i, "t", "b") for i in range(40)] + [(7, "t", "c"), (None, None, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df, {"a": 200.0, "b": 40.0 * 1200, "c": 2 * 2500.0}, total=200.0 + 40 * 1200 + 2 * 2500)
    got = {(r["doc_id"], r["text"], r["source"]): r["n"] for r in out.groupBy("doc_id", "text", "source").count().withColumnRenamed("count", "n").collect()}
    rate = {"a": 0.5, "b": 1200.0, "c": 2500.0}
    who = lambda d, t: d if d is not None else "null:" + (hashlib.md5(t.encode()).hexdigest() if t is not None else "")
    want = {(d, t, s): plain_count(rate[s], who(d, t)) for d, t, s in docs}
    assert got == {k: n for k, n in want.items() if n}
    # the draws of high rates spread as Poisson's do
    b = [n for (_, _, s), n in want.items() if s == "b"]
    mean = sum(b) / len(b)
    assert abs(mean - 1200) < 5 * math.sqrt(1200 / 40) and 0.4 < sum((x - mean) ** 2 for x in b) / len(b) / 1200 < 2.2
    # null ids don't share one draw
    assert 20 < sum(n > 0 for (d, _, s), n in want.items() if d is None and s == "a") < 60


def test_high_rates(spark):
    docs = spark.createDataFrame([(i, "t", "a") for i in range(20)], "doc_id long, text string, source string")
    n = mixing.mix(docs, {"a": 1.0}, total=20 * 1000.5).count()
    assert abs(n - 20010) < 200
    assert mixing.mix(docs, {"other": 1.0}).count() == 0


def test_odd(spark, odd):
    out = mixing.mix(odd("copy"), total=90.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", "shuffle_key"]
    line = "Plain words stand here in one line and more words follow them."
    # a row repeated whole has the same copies twice, and every source meets its share of 90 rows in the mean
    rows = out.collect()
    per = {}
    for r in rows:
        per.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["copy"])
    assert sorted(per.get((1, line, "a"), [])) == sorted(2 * list(range(len(per.get((1, line, "a"), [])) // 2)))
    assert all(sorted(set(c)) == list(range(max(c) + 1)) for c in per.values()) and (None, None, "b") in per
    assert mixing.mix(odd(rows=[])).count() == 0
