import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import fuzzy
from recollect.operators import digest, expand, extract, graph, link, resolve, vectors
from recollect.plans import queries
from recollect.sources import sinks

CHUNK = "project string, file string, doc_ord long, chunk int, response string, error string"


@pytest.fixture(scope="module")
def built(spark):
    answer = {
        "entities": [
            {"name": "Tidewater Works", "type": "organization", "description": "maker", "aliases": ["Tidewater"]}, {"name": "Tidewater", "type": "Concept", "aliases": []},
            {"name": "Ines Park", "type": "Person", "description": "chief"}, {"name": "Lantern Q", "type": "Product"}, {"name": "EN 4711", "type": "Policy"}, "not an object", {"name": "tidewater works"},
        ],
        "relations": [{"source": "Ines Park", "relation": "chairs", "target": "Tidewater"}, {"source": "Tidewater Works", "relation": "ships", "target": "Lantern Q"}, {"source": "Tidewater", "relation": "audited under", "target": "EN 4711"}, {"source": "Tidewater", "relation": "is", "target": "tidewater"}],
        "facts": [{"text": "Ines Park chairs Tidewater Works.", "entities": ["Ines Park", "Tidewater Works"]}, {"text": "Tidewater ships Lantern Q.", "entities": ["Tidewater", "Lantern Q"]}, "Tidewater is audited.", {"text": "short", "entities": []}],
    }
    rows = [("p", "a.md", 0, 0, json.dumps(answer), None), ("p", "b.md", 1, 0, "nothing", None), ("p", "c.md", 2, 0, "[1, 2]", None)]
    parsed = extract.parse_responses(spark.createDataFrame(rows, CHUNK)).cache()
    return parsed, graph.build_graph(*extract.raw_tables(parsed))


def test_parsing(built):
    parsed, _ = built
    row = parsed.where("file = 'a.md'").first()
    assert [e["name"] for e in row["entities"]] == ["Tidewater Works", "Tidewater", "Ines Park", "Lantern Q", "EN 4711"]
    assert len(row["relations"]) == 3 and all(r["grounded"] for r in row["relations"])
    assert [f["text"] for f in row["facts"]] == ["Ines Park chairs Tidewater Works.", "Tidewater ships Lantern Q.", "Tidewater is audited."]
    assert {r["file"]: r["parse_ok"] for r in parsed.collect()} == {"a.md": True, "b.md": False, "c.md": False}


def test_graph(built):
    g = built[1]
    nodes = {n["id"]: n for n in g.nodes.collect()}
    assert set(nodes) == {"tidewater-works", "ines-park", "lantern-q", "en-4711"}
    tidewater = nodes["tidewater-works"]
    assert (tidewater["mentions"], tidewater["degree"], tidewater["type"], tidewater["aliases"], tidewater["description"]) == (2, 3, "Organization", ["Tidewater"], "maker")
    assert tidewater["facts"] == ["Ines Park chairs Tidewater Works.", "Tidewater ships Lantern Q."]
    assert g.edges.count() == 3 and g.facts.count() == 3


def test_failed_chunks_hold_back_documents(spark):
    ok = json.dumps({"entities": [{"name": "Only A"}]})
    rows = [("p", "a.md", 0, 0, ok, None), ("p", "b.md", 1, 0, ok, None), ("p", "b.md", 1, 1, None, "down")]
    parsed = extract.parse_responses(spark.createDataFrame(rows, CHUNK))
    assert [r["file"] for r in extract.clean_documents(parsed).collect()] == ["a.md"]
    extract.check_provider(parsed)
    with pytest.raises(RuntimeError):
        extract.check_provider(extract.parse_responses(spark.createDataFrame([("p", "b.md", 1, i, None, "down") for i in range(6)], CHUNK)))


def test_provider_retries(spark):
    def make():
        tries = {}

        def ask(text):
            tries[text] = tries.get(text, 0) + 1
            if text == "bad" or tries[text] < 2:
                raise RuntimeError("cold")
            return "{}"

        return ask

    chunks = spark.createDataFrame([("p", "a", 0, 0, "good"), ("p", "a", 0, 1, "bad")], "project string, file string, doc_ord long, chunk int, text string")
    got = {r["chunk"]: (r["response"], r["error"]) for r in extract.run_extractor(chunks, make, waits=()).collect()}
    assert got == {0: ("{}", None), 1: (None, "cold")}


def test_near_duplicates_merge(spark):
    rows = [("p", i, n, t, d, [], "f", 0) for i, (n, t, d) in enumerate([("Solar Panel", "Product", "x"), ("Solar Panels", "Concept", "x"), ("Solar Panels", "Product", "y"), ("Wind Farm", "Product", "z")])]
    raw = spark.createDataFrame(rows, "project string, seq long, name string, type string, description string, aliases array<string>, file string, chunk int")

    class Two:
        model = "two"

        def vectors(self, texts):
            return [[1.0, 0.0] if "solar" in t.lower() else [0.0, 1.0] for t in texts]

    nodes, resolution = resolve.resolve(raw, vectors.embedder(Two()))
    got = {n["name"]: n for n in nodes.collect()}
    assert set(got) == {"Solar Panels", "Wind Farm"}
    merged = got["Solar Panels"]
    assert (merged["mentions"], merged["aliases"], merged["type"], merged["description"], merged["ord"]) == (3, ["Solar Panel"], "Product", "x", 0)
    assert {r["norm_key"]: r["node_id"] for r in resolution.collect()} == {"solar panel": "solar-panels", "solar panels": "solar-panels", "wind farm": "wind-farm"}


def test_ids_with_numbered_names(spark):
    names = ["Report", "Report 2", "Report", "Report", "Report-2", "Other"]
    df = spark.createDataFrame([("p", str(i), i, n) for i, n in enumerate(names)], "project string, key string, ord long, name string")
    got = [r["id"] for r in resolve.assign_ids(df).orderBy("ord").collect()]
    assert got == ["report", "report-2", "report-3", "report-4", "report-2-2", "other"]


def test_ids_by_windows_equal_one_after_the_other(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for project in range(30):
        used, stems = set(), ["a", "a 2", "a 3", "a 2 2", "a 2 3", "a 4", "a 12", "a 02", "a 1", "b", "b 2", "2", "!", "untitled 2"]
        names = rng.choices(stems[: rng.randint(2, len(stems))], k=rng.randint(0, 60))
        for i, name in enumerate(names):
            base = name.replace(" ", "-") if name != "!" else "untitled"
            got, k = base, 2
            while got in used:
                got, k = f"{base}-{k}", k + 1
            used.add(got)
            rows.append((str(project), str(i), i * 10, name))
            want[str(project), str(i)] = got
    df = spark.createDataFrame(rows, "project string, key string, ord long, name string")
    assert {(r["project"], r["key"]): r["id"] for r in resolve.assign_ids(df).collect()} == want
    assert resolve.assign_ids(df.limit(0)).count() == 0


def test_likeness_bounds(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcde x\U0001d400é", k=rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(str(i % 7), i, n) for i, n in enumerate(names)], "project string, ord long, name string")
    df = df.select("project", "ord", F.col("ord").cast("string").alias("id"), "name", F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("degree"))
    for e in ("abcab d", "\U0001d400xé", "e"):
        tight, loose = fuzzy.most_ratio(F.col("name"), F.lit(e)), fuzzy.most_shared(F.col("name"), e)
        for n, t, s in df.select("name", tight, loose).collect():
            true = difflib.SequenceMatcher(None, n, e).ratio()
            assert true <= t + 1e-12 and true <= s + 1e-12, (n, e)
        for r in expand._alike(df, e, 0.6).groupBy("project").agg(F.max(F.struct("_s", F.lower("name").alias("n"))).alias("m")).collect():
            best = max((difflib.SequenceMatcher(None, n.lower(), e).ratio(), n.lower()) for i, n in enumerate(names) if str(i % 7) == r["project"])
            assert tuple(r["m"]) == best
        reached = {str(i % 7) for i, n in enumerate(names) if difflib.SequenceMatcher(None, n.lower(), e).ratio() >= 0.6}
        assert {r["project"] for r in expand._alike(df, e, 0.6).select("project").collect()} == reached


def test_expand_digest_link(spark, built):
    g = built[1]
    by = lambda e, **k: [(r["id"], r["matched_by"]) for r in expand.find_entity(g.nodes, e, **k).collect()]
    assert by("en-4711") == [("en-4711", 1)] and by("TIDEWATER") == [("tidewater-works", 2)] and by("lantern") == [("lantern-q", 3)] and by("ines parc") == [("ines-park", 4)] and by("zzzz") == []
    with pytest.raises(ValueError):
        expand.find_entity(g.nodes, " ")
    start = g.nodes.where("id = 'ines-park'").select("project", "id")
    assert {r["id"]: r["hop"] for r in expand.hops(g.edges, start, 2).collect()} == {"ines-park": 0, "tidewater-works": 1, "lantern-q": 2, "en-4711": 2}
    text = digest.digest_text(g, "p")
    assert len(text) // 4 < 1500 and "- Tidewater Works: maker" in text and "- Ines Park, chairs: Tidewater Works" in text
    new = link.imported(g, "q", "p", 2)
    ids = {r["id"] for r in new.nodes.collect()}
    assert len(ids) == 2 and all(i.startswith("p:") for i in ids)
    twice = link.imported(link.link(g, "q", "p", 2), "q", "p", 2)
    assert [d.count() for d in twice] == [0, 0, 0]


def test_empty_graph(spark, built):
    g = graph.Graph(*(d.limit(0) for d in built[1]))
    assert "0 entities" in digest.digest_text(g, "p")
    assert "<svg" in sinks.mindmap_html(g, "p")


def test_mindmap_escapes(spark, built):
    bad = "</script><b>x"
    g = graph.Graph(built[1].nodes.withColumn("name", F.lit(bad)), built[1].edges, built[1].facts)
    page = sinks.mindmap_html(g, "p", name=bad)
    assert bad not in page and "\\u003c/script" in page


def test_search(spark, built):
    class Words:
        model = "words"
        vocabulary = ["tidewater", "ines", "widget", "iso"]

        def vectors(self, texts):
            return [[float(t.lower().count(w)) or 0.001 for w in self.vocabulary] for t in texts]

    index = vectors.build_index(built[1].nodes, built[1].facts, vectors.embedder(Words()), "words")
    hits = vectors.search(index, Words().vectors(["who is ines"])[0], 2).collect()
    assert [h["id"] for h in hits if h["kind"] == "node" and h["rank"] == 1] == ["ines-park"]
    assert vectors.search(index, [1.0, 2.0], 2).count() == 0
    assert "Ines Park" in sinks.search_markdown("who", hits)


def test_aliases_of_all_keys(spark, tmp_path):
    keys = [*range(3001), *range(11_000, 12_000)]
    spark.createDataFrame([(k, "b") for k in keys], "p_partkey int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    order = sorted(keys, key=lambda k: (k % 2 == 0, k))
    assert queries._claims(spark, str(tmp_path)).select("seq").distinct().count() == len(keys)
    assert [int(r["name"][5:]) for r in queries._claims(spark, str(tmp_path)).orderBy("seq").select("name").collect()] == order
    seen, parent, surface = set(), {}, {}
    for k in order:
        seen.add(f"part {k}")
        if (a := f"part {3 * k}") not in seen and a not in parent:
            parent[a], surface[a] = f"part {k}", f"part-{3 * k}"

    def root(n):
        while n in parent:
            n = parent[n]
        return n

    got = queries.alias_resolution(spark, str(tmp_path)).collect()
    assert sorted((r["alias"], r["root"]) for r in got) == sorted((a, root(a)) for a in parent)
    mentions, aliases = {}, {}
    for k in order:
        mentions[root(f"part {k}")] = mentions.get(root(f"part {k}"), 0) + 1
    for a in parent:
        aliases.setdefault(root(a), []).append(surface[a])
    want = [(n.replace(" ", "-"), n.capitalize(), m, "|".join(sorted(aliases.get(n, []))[:8])) for n, m in mentions.items()]
    assert sorted(tuple(r) for r in queries.resolved_nodes(spark, str(tmp_path)).collect()) == sorted(want)


def test_misspelt_name_among_all_nodes(spark, monkeypatch):
    rows = [("p", 1, "nation:7", "INDIA"), ("p", 2, "customer:1", "in xia"), ("p", 3, "orders:1", "Order 1")]
    nodes = spark.createDataFrame(rows, "project string, ord long, id string, name string").selectExpr("*", "array() as aliases", "0L as degree")
    monkeypatch.setattr(queries, "star_graph", lambda *_: graph.Graph(nodes, None, None))
    assert [tuple(r) for r in queries.entity_lookup_fuzzy(spark, "").collect()] == [("customer:1", 4)]
