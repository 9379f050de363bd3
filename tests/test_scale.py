"""What grows with the input only as it must: work done once, and rows of a task's Python at a time."""

import pytest

from jobs import entity_index
from recollect.operators import dedup, graph, similar, vectors
from recollect.plans.memory import Memory
from recollect.plans.queries import QUERIES
from recollect.session import shared_dir
from recollect.sources import convert

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_to_markdown", "page_heading_chunks"])
def test_pages_go_to_python_few_at_a_time(spark, name):
    """Arrow would send 10,000 pages at once, whatever their length."""
    made = plan(QUERIES[name](spark, SF))
    assert "BatchEvalPython" in made and "Arrow" not in made


@pytest.mark.parametrize("name", ["page_to_markdown", "page_heading_chunks"])
def test_long_pages_go_to_python_fewer_at_a_time(spark, tmp_path, monkeypatch, name):
    """What a worker holds at once is bounded in characters too, not only in pages."""
    seen = []

    def held(html):  # Spark sends a task's rows by hundreds
        seen.append(len(html or ""))
        return None if html is None else f"at once {sum(seen[(len(seen) - 1) // 100 * 100 :])} characters"

    spark.range(0, 120, 1, 1).selectExpr("id as page_id", "'u' as url", "repeat('<p>word</p> ', 10000) as html").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(convert, "html_to_markdown", convert.F.udf(held, useArrow=False).asNondeterministic())
    made = QUERIES[name](spark, str(tmp_path))
    found = [int(r[-1].split()[2]) for r in made.collect()]
    assert len(found) == 120 and 120_000 <= max(found) <= 100 * 16_384 + 120_000


def test_long_and_missing_pages_are_converted_once(spark):
    """Empty rows that go along with long pages leave nothing behind; other columns stay."""
    pages = [(1, None, "a"), (2, "", "b"), (3, "<h1>T</h1>" + "<p>Å word</p>" * 9000, "c"), (4, "<script>x</script>", None), (5, "<p>p</p>", "e")]
    made = convert.markdown_pages(spark.createDataFrame(pages, "page_id long, html string, kind string"), out="body")
    assert made.columns == ["page_id", "kind", "body"]
    assert sorted(map(tuple, made.collect())) == [(i, kind, convert.html_markdown(html)) for i, html, kind in pages]


def test_index_extracts_once(spark):
    """Mentions, degrees and what projects share are read from one extraction, not from the documents again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = entity_index.index(entity_index.shaped(docs), 200, 20)
    assert not [f for f in found.inputFiles() if f"{shared_dir(spark)}/recollect/" not in f]


@pytest.mark.parametrize("name,other", [("document_edges", "facts_of"), ("document_facts", "edges_of")])
def test_edges_and_facts_make_only_themselves(spark, monkeypatch, name, other):
    def never(*_):
        raise AssertionError(other)

    monkeypatch.setattr(graph, other, never)
    QUERIES[name](spark, SF)


def test_dedup_normalises_texts_once(spark):
    """Ranges are drawn from a sample; the keys it is drawn from are not computed for it."""
    calls = spark.sparkContext.accumulator(0)

    def body(i):
        calls.add(1)
        return f"text {i} " * 100

    docs = spark.range(40).selectExpr("'p' as project", "concat(id, '.md') as file", "id as doc_ord").withColumn("body", dedup.F.udf(body)("doc_ord"))
    dedup.document_dedup(docs)
    assert calls.value == 40


def test_nothing_new_reads_no_text(spark, tmp_path, monkeypatch):
    """An update of documents that are as the last run left them normalises and compares none; a change is found."""
    def docs(*rows):
        made = spark.createDataFrame([(p, f"h{b}", f"Harbour stands beside Granite and {b} for ever. " * 9) for p, b in rows], "rel_path string, hash string, body string")
        return made.selectExpr("'p' as project", "*", "length(body) as size", "cast(null as timestamp) as modified", "'text' as method", "cast(length(body) as long) as chars")

    m = Memory(spark, str(tmp_path / "mem"), merge_cosine=None)
    m.record(docs(("a.md", "Lantern"), ("b.md", "Lantern"), ("c.md", "Meadow")), "p")
    assert m.extract("p") == {"chunks": 2, "failed_chunks": 0, "documents": 2}
    keys, asked = dedup.document_keys, []
    monkeypatch.setattr(dedup, "document_keys", lambda d: asked.append(1) or keys(d))
    assert m.extract("p") == {"chunks": 0, "failed_chunks": 0, "documents": 2} and not asked
    # the copy's original changes, so the copy is read too
    m.record(docs(("a.md", "Orchard")), "p")
    assert m.extract("p") == {"chunks": 2, "failed_chunks": 0, "documents": 3} and asked


def test_offline_index_is_one_pass(spark):
    """Vectors and cells of the offline embedder: those of a look-up of each text, without a join, and only texts go to Python."""
    nodes = spark.range(80).selectExpr("'p' as project", "id as ord", "concat('n', id) as id", "concat('Name ', id % 7, ' of ', id) as name", "'Concept' as type", "'' as description", "cast(array() as array<string>) as aliases", "array('f') as sources", "array(concat('says ', id)) as facts")
    facts = spark.range(80).selectExpr("'p' as project", "id as ord", "if(id = 3, '?', concat('A fact, ', id % 9, ' times told')) as text", "array('n1') as nodes", "'f' as file")
    items = vectors.index_items(nodes, facts)
    provider = vectors.HashedWords()
    placed, points = vectors.placed_index(items, provider)
    made = plan(placed)
    assert made.count("ArrowEvalPython") == 2 and "Join" not in made  # one each for nodes and facts
    found = vectors.build_index(nodes, facts, vectors.embedder(provider))
    rows = similar.assigned(found, "vec", points)
    by = lambda d: {(r["kind"], r["pos"]): (r["text"], list(r["vec"]), r["cell"], round(r["away"], 9), r["dim"], r["model"]) for r in d.collect()}
    assert by(placed) == by(rows) and len(by(rows)) == 160
    assert abs(similar.pivots(found, "pos", "vec") - points).max() < 1e-9
