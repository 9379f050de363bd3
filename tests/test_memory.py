import hashlib
import io
import os
import random
import time
import zipfile

import pytest

from recollect import cli
from recollect.operators import chunk, extract
from recollect.plans.memory import TABLES, Memory
from recollect.sources import convert, files
from recollect.streaming.ingest import ingest_stream


@pytest.fixture()
def folder(tmp_path):
    src = tmp_path / "src"
    (src / "sub dir").mkdir(parents=True)
    (src / "a.txt").write_text("Acmecorp makes Widgets in Berlin. Acmecorp was founded by Janet.")
    (src / "sub dir" / "b.html").write_text("<html><head><title>t</title></head><body><h1>Widgets</h1><p>Widgets are sold by <b>Acmecorp</b>.</p><script>x</script></body></html>")
    (src / "._fork").write_text("no")
    (src / "link.gdoc").write_text("no")
    (src / ".DS_Store").write_text("no")
    (src / "empty.bin").write_bytes(b"\x00")
    return tmp_path, src


def test_scan(spark, folder):
    _, src = folder
    assert sorted(r["rel_path"] for r in files.scan(spark, str(src), "p").collect()) == ["a.txt", "empty.bin", "sub dir/b.html"]
    assert [r["rel_path"] for r in files.scan(spark, str(src), "p", 1).collect()] == ["a.txt"]
    assert files.scan(spark, str(src) + "-none", "p").count() == 0


def test_build_update_link(spark, folder, tmp_path, capsys):
    root, src = folder
    m = Memory(spark, str(root / "memory"))
    out = m.build(str(src), "one", "Project One")
    assert out["ingest"] == {"total": 3, "converted": 2, "cached": 0, "empty_or_failed": 1}
    assert out["graph"]["nodes"] >= 2 and out["graph"]["vectors"] >= 2
    assert m.build(str(src), "one")["ingest"]["cached"] == 3
    (src / "a.txt").write_text("Acmecorp makes Gadgets in Hamburg. Acmecorp was bought by Robert.")
    again = m.update("one")
    assert again["ingest"]["converted"] == 1
    names = {r["name"] for r in m.graph("one").nodes.collect()}
    assert "Gadgets" in names and "Berlin" not in names
    assert "Acmecorp" in m.overview() and "Acmecorp" in m.query_markdown("Acmecorp")
    found = m.expand("acmecorp")
    assert found["center"]["id"] == "acmecorp" and found["relations"]
    assert m.expand("qqqqqq") is None
    assert m.stats()["nodes"] == len(names)
    m.build(str(src / "sub dir"), "two")
    assert m.link("two", "one", k=2)["linked"] == 2
    assert m.link("two", "one", k=2)["linked"] == 0
    assert {r["from_project"] for r in m.read("nodes", "two").collect()} == {None, "one"}
    assert {h["project"] for h in m.query("acmecorp widgets", scope="all")} == {"one", "two"}
    with pytest.raises(ValueError):
        m.sole(None)
    paths = m.export(str(tmp_path / "out"), "one", graph=True, mindmap=True)
    assert [os.path.basename(p) for p in paths] == ["one-memory.md", "one-graph.json", "one-mindmap.html"]
    assert "one" in cli.main(["list"], m) and "Acmecorp" in cli.main(["expand", "acmecorp", "--project", "one"], m)
    assert m.status()["projects"] == 2


def test_stream(spark, folder):
    root, src = folder
    m = Memory(spark, str(root / "stream"))
    for _ in range(2):
        q = ingest_stream(m, str(src), "s", str(root / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert m.read("documents", "s").count() == 2 and m.read("manifest", "s").count() == 3


def test_names_of_projects(spark, folder):
    root, src = folder
    m = Memory(spark, str(root / "named"))
    m.ingest(str(src), "a/b")
    assert m.read("documents", "a/b").count() == 2 and m.read("manifest", "a/b").count() == 3
    names = ["a/b", "50%25 off", "x=y", "{odd} [name]?*", "naïve: 日本", "%", "a\\b"]
    for name in names:
        m.write("projects", spark.createDataFrame([(name, name, "", "m", 1, "")], TABLES["projects"]), name)
        assert [r["name"] for r in m.read("projects", name).collect()] == [name]
    assert sorted(r["project"] for r in m.read("projects").collect()) == sorted(names)
    m.reset("a/b")
    assert m.read("documents", "a/b").count() == 0
    with pytest.raises(ValueError):
        m.ingest(str(src), "")


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


class TestUpdates:
    """Files are listed before they are opened; what is written is in proportion to what changed."""

    def make(self, tmp_path, n=40, size=20):
        src = tmp_path / "src"
        src.mkdir()
        for i in range(n):
            (src / f"f{i:02}.md").write_text(f"Document number {i} names Entity and Castle{'x' * i} at length. " + " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(size)))
        return src

    def test_unchanged_folder_is_not_opened(self, spark, tmp_path, monkeypatch):
        src = self.make(tmp_path)
        m = Memory(spark, str(tmp_path / "mem"))
        assert m.ingest(str(src), "p") == {"total": 40, "converted": 40, "cached": 0, "empty_or_failed": 0}
        before = written(tmp_path / "mem")
        opened = []
        contents = files.contents

        def watched(spark, root, project, listed):
            opened.append(sorted(r["rel_path"] for r in listed.collect()))
            return contents(spark, root, project, listed)

        monkeypatch.setattr(files, "contents", watched)
        assert m.ingest(str(src), "p") == {"total": 40, "converted": 0, "cached": 40, "empty_or_failed": 0}
        assert opened == [[]] and written(tmp_path / "mem") == before
        # one file changed, one only touched, one is new
        (src / "f03.md").write_text("Document three is about Gardens now, and about nothing else.")
        os.utime(src / "f04.md", (2e9, 2e9))
        (src / "new.md").write_text("An old file that was moved here with its old time.")
        os.utime(src / "new.md", (1e9, 1e9))
        assert m.ingest(str(src), "p") == {"total": 41, "converted": 2, "cached": 39, "empty_or_failed": 0}
        assert opened[1] == ["f03.md", "f04.md", "new.md"]
        assert m.ingest(str(src), "p")["cached"] == 41 and opened[2] == []
        assert m.ingest(str(src), "p", verify=True)["cached"] == 41 and len(opened[3]) == 41
        bodies = {r["rel_path"]: r["body"] for r in m.read("documents", "p").collect()}
        assert len(bodies) == 41 and "Gardens" in bodies["f03.md"]

    def test_content_outside_the_times_is_not_read(self, spark, tmp_path):
        """The condition on times reaches the scan of the files."""
        src = self.make(tmp_path, 3)
        os.utime(src / "f01.md", (1e9, 1e9))
        listed = files.listing(spark, str(src), "p")
        assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
        rows = files.contents(spark, str(src), "p", listed.where("rel_path = 'f01.md'"))
        assert "GreaterThanOrEqual(modificationTime" in rows._jdf.queryExecution().executedPlan().toString()
        assert [r["rel_path"] for r in rows.collect()] == ["f01.md"]

    def test_writes_follow_the_change(self, spark, tmp_path):
        src = self.make(tmp_path, size=1200)
        m = Memory(spark, str(tmp_path / "mem"))
        m.build(str(src), "p")
        logs = lambda: sum(written(tmp_path / "mem" / n) for n in ("documents", "manifest", "parsed"))
        before = logs()
        (src / "f03.md").write_text("Document three is about Gardens now, and about nothing else.")
        m.build(str(src), "p")
        assert logs() - before < before / 10
        names = {r["name"] for r in m.graph("p").nodes.collect()}
        assert "Gardens" in names and "Castlexxx" not in names
        # a document that is emptied, one that is deleted, one too short for a chunk
        (src / "f04.md").write_text("")
        (src / "f05.md").unlink()
        (src / "f06.md").write_text("two words")
        out = m.build(str(src), "p", prune=True)
        assert out["ingest"] == {"total": 38, "converted": 1, "cached": 37, "empty_or_failed": 0}
        names = {r["name"] for r in m.graph("p").nodes.collect()}
        assert not {"Castle" + "x" * i for i in (3, 4, 5, 6)} & names and "Castlexxxxxxx" in names
        rows = {n: sorted(map(str, m.read(n, "p").drop("version").collect())) for n in ("documents", "manifest", "parsed")}
        assert m.compact("p")["documents"] == 38
        assert rows == {n: sorted(map(str, m.read(n, "p").drop("version").collect())) for n in rows}
        assert m.extract("p")["chunks"] == 0  # nothing is pending, the short document included
        # an update equals a build from nothing
        m.build(str(src), "q")
        for name in ("nodes", "edges", "facts"):
            one, two = ({str(r.asDict() | {"project": ""}) for r in m.read(name, p).collect()} for p in "pq")
            assert one == two


def converted(spark, contents, make=convert.Providers, **options):
    rows = [("p", path, len(data), None, "h", bytearray(data)) for path, data in contents.items()]
    files_df = spark.createDataFrame(rows, files.FILES)
    return {r["rel_path"]: (r["body"], r["method"]) for r in convert.convert_files(files_df, make, **options).collect()}


def test_routes(spark):
    """Each kind of work over the files that need it; pages of scans are rows of their own, back in order."""
    some = {"a.png": b"x", "b.pdf": b"abc", "c.mp3": b"x", "d.csv": b"a,b\n1,2\n", "e.json": b"{bad", "f.md": b" text ", "g.bin": b"\x00"}
    make = lambda: convert.Providers(ocr_image=lambda b: "" if b == b"b" else "seen " + b.decode(), caption=lambda b: "a chart", pages=lambda b, n: [bytes([c]) for c in b][:n], transcribe=lambda b: "said")
    assert converted(spark, some, make) == {
        "a.png": ("## Recognised text\n\nseen x\n\n## Picture\n\na chart", "recognised+described"),
        "b.pdf": ("## Recognised text\n\n<!-- page 1 -->\nseen a\n\n<!-- page 3 -->\nseen c", "recognised"),
        "c.mp3": ("## Recording\n\nsaid", "heard"), "d.csv": ("| a | b |\n| --- | --- |\n| 1 | 2 |", "text"), "e.json": ("", "none"), "f.md": ("text", "text"), "g.bin": ("", "none"),
    }
    plain = converted(spark, some)
    assert {k for k, v in plain.items() if v[0]} == {"d.csv", "f.md"} and len(plain) == len(some)
    assert converted(spark, some, make, ocr="off", vision="off")["a.png"] == ("", "none")

    def failing():
        def fail(*_):
            raise RuntimeError("no")

        return convert.Providers(ocr_image=fail, pages=lambda b, n: fail(), caption=fail, transcribe=fail)

    assert converted(spark, some, failing) == plain


def test_pages_are_many_tasks(spark):
    """A scan of sixty pages is recognised by many tasks."""

    def make():
        def seen(image):
            from pyspark import TaskContext

            return f"task {TaskContext.get().partitionId()}"

        return convert.Providers(ocr_image=seen, pages=lambda b, n: [bytes([i]) for i in range(min(n, 90))])

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        body = converted(spark, {"a.pdf": b"x"}, make)["a.pdf"][0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert body.count("<!-- page ") == 60 and [int(x.split()[0]) for x in body.split("<!-- page ")[1:]] == list(range(1, 61))
    assert len({x for x in body.split("\n") if x.startswith("task ")}) > 1


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Own"><w:name w:val="My Head"/><w:basedOn w:val="H2"/></w:style>
<w:style w:type="paragraph" w:styleId="H2"><w:name w:val="Custom"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="Loop"><w:name w:val="Loop"/><w:basedOn w:val="Loop"/></w:style></w:styles>"""
NUMBERS = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>"""


def para(text, style=None, level=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr>' if level is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_text_documents(spark):
    """Headings by style, lists by numbering, tables; the chunks are those of the same document in Markdown."""
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = para("Plan", "H1") + para("Some opening words.") + para("one", level=0) + para("deep", level=1) + para("two", level=0) + para("Costs", "Own") + f"<w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + para("End.", "Loop") + "<w:p><w:r><w:delText>gone</w:delText></w:r></w:p>"
    data = office({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": STYLES, "word/numbering.xml": NUMBERS})
    want = "# Plan\n\nSome opening words.\n\n1. one\n  - deep\n2. two\n\n## Costs\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\nEnd."
    got = converted(spark, {"a.docx": data, "a.md": want.encode(), "bad.docx": b"no zip"})
    assert got["a.docx"] == got["a.md"] == (want, "text") and got["bad.docx"] == ("", "none")
    chunks = lambda n: [r["text"] for r in chunk.chunk_documents(spark.createDataFrame([(got[n][0],)], "body string"), 6, 2, None).orderBy("chunk").collect()]
    assert chunks("a.docx") == chunks("a.md") and len(chunks("a.md")) > 2


def test_slides(spark):
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda kind, *lines: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{"".join(lines)}</p:txBody></p:sp>'
    line = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    slide = lambda *s: f"<p:sld {ns}>{''.join(s)}</p:sld>"
    data = office({"ppt/slides/slide10.xml": slide(shape('<p:ph type="title"/>', line("Last"))), "ppt/slides/slide2.xml": slide(shape('<p:ph type="ctrTitle"/>', line("First")), shape("", line("point"), line("detail", 1)))})
    assert converted(spark, {"a.pptx": data})["a.pptx"][0] == "## First\n\n- point\n  - detail\n\n## Last"


def test_html():
    md = convert.html_markdown("<h1>T</h1><nav>n</nav><p>a <b>b</b> <a href='u'>l</a></p><ol><li>x</li><li>y</li></ol><!-- c --><script>z</script>")
    assert md.startswith("# T") and "a **b** [l](u)" in md and "1. x\n2. y" in md and "z" not in md


def test_answers_are_kept_when_the_provider_fails(spark, tmp_path):
    """Batches answered before an outage stay; the next run asks for the rest only; an interrupted write loses nothing."""
    src = tmp_path / "src"
    src.mkdir()
    for i in range(24):
        (src / f"f{i:02}.md").write_text(f"Document number {i} names Entity{i} at length, and nothing else of note is said in it.")
    log, down = tmp_path / "asked", tmp_path / "down"
    down.write_text("")

    def make():
        def ask(text):
            if down.exists() and log.exists() and len(log.read_text().split()) >= 5:
                raise RuntimeError("down")
            with open(log, "a") as f:
                f.write("x ")
            return '{"entities": [{"name": "Entity", "type": "System"}], "relations": [], "facts": []}'

        return ask

    m = Memory(spark, str(tmp_path / "mem"), extractor=make)
    m.ingest(str(src), "p")
    extract_now = extract.run_extractor
    try:
        extract.run_extractor = lambda chunks, make: extract_now(chunks.coalesce(1), make, attempts=1, waits=())
        with pytest.raises(RuntimeError):
            m.extract("p", batch=1)
        kept = m.read("parsed", "p").count()
        assert 0 < kept <= 5
        down.unlink()
        assert m.extract("p", batch=100) == {"chunks": 24 - kept, "failed_chunks": 0, "documents": 24}
    finally:
        extract.run_extractor = extract_now
    # a write that stopped between its two renames
    os.rename(tmp_path / "mem/parsed/project=p", tmp_path / "mem/parsed/_old-project=p")
    assert m.read("parsed", "p").count() == 24


def test_an_outage_ends_the_job_of_all_tasks(spark, tmp_path):
    log = tmp_path / "asked"

    def make():
        def ask(text):
            with open(log, "a") as f:
                f.write("x ")
            time.sleep(0.3)
            raise RuntimeError("down")

        return ask

    chunks = spark.createDataFrame([("p", f"f{i}", i, 0, f"text {i}") for i in range(240)], "project string, file string, doc_ord long, chunk int, text string").repartition(40)
    breaker = extract.Breaker(spark)
    with pytest.raises(RuntimeError, match="in a row"):
        breaker.cut(extract.run_extractor(chunks, breaker.watched(make), attempts=1, waits=()), "parsed")
    # without the breaker each of 40 tasks asks for six chunks
    assert 6 <= len(log.read_text().split()) <= 80


def test_failures_between_answers_are_no_outage(spark):
    def make():
        def ask(text):
            if int(text) % 3:
                raise RuntimeError("busy")
            return "{}"

        return ask

    chunks = spark.createDataFrame([("p", f"f{i}", i, 0, str(i)) for i in range(60)], "project string, file string, doc_ord long, chunk int, text string").coalesce(1)
    breaker = extract.Breaker(spark)
    got = breaker.cut(extract.run_extractor(chunks, breaker.watched(make), attempts=2, waits=(0,)), "parsed").df
    assert got.count() == 60 and got.where("error is null").count() == 20 and not breaker.open
    # a chunk counts once, however often it is tried again, and an answer ends the row
    assert breaker.outcomes.value == (20, 2)


def test_health_of_providers(spark, tmp_path):
    class Down:
        model = "down"

        def vectors(self, texts):
            raise OSError("no such host")

    fine = Memory(spark, str(tmp_path / "m"), extractor=lambda: lambda text: "{}").status(ask=True)
    assert fine["health"] == {"embedding": "ok", "extractor": "ok"} and "health" not in Memory(spark, str(tmp_path / "m")).status()

    def unset():
        raise KeyError("token")

    down = Memory(spark, str(tmp_path / "m"), extractor=unset, embed_with=Down()).health()
    assert down == {"embedding": "OSError: no such host", "extractor": "KeyError: 'token'"}
    assert '"health"' in cli.main(["status", "--ask"], Memory(spark, str(tmp_path / "m")))


class TestDerive:
    """A derivation is left out where no answer changed, and embeds new texts only; the outcome is that of a whole one."""

    @staticmethod
    def counting(path):
        from recollect.operators.vectors import HashedWords

        class Counting(HashedWords):
            model = "counting"

            def vectors(self, texts):
                with open(path, "a") as f:
                    f.writelines(f"{t}\n" for t in texts)
                return super().vectors(texts)

        return Counting()

    @staticmethod
    def held(m):
        """Everything that is derived, orders as ranks, vectors by what they are of."""
        out = {}
        for name in ("nodes", "edges", "facts"):
            rows = [r.asDict() for r in m.read(name, "p").collect()]
            out[name] = [{k: v for k, v in r.items() if k != "ord"} for r in sorted(rows, key=lambda r: r["ord"])]
        out["vectors"] = sorted((r["kind"], r["id"] or "", r["file"] or "", r["text"], tuple(r["vec"])) for r in m.read("vectors", "p").collect())
        return out

    def test_edits(self, spark, tmp_path):
        rnd = random.Random(3)
        words = ["Harbour", "Harbours", "Lantern", "Granite", "Meadow", "Orchard", "Saddle", "Timber", "Velvet", "Willow"]
        src, asked = tmp_path / "src", tmp_path / "asked"
        src.mkdir()
        line = lambda: f"{rnd.choice(words)} stands beside {rnd.choice(words)}. Later {rnd.choice(words)} met the {rnd.choice(words)} number {rnd.randrange(99)}."
        for i in range(6):
            (src / f"d{i}.md").write_text(line())
        m = Memory(spark, str(tmp_path / "mem"), embed_with=self.counting(str(asked)))
        m.build(str(src), "p")
        seen = asked.read_text().splitlines()
        assert len(seen) == len(set(seen)) > 6
        counts = m.update("p")["graph"]
        assert asked.read_text().splitlines() == seen and counts["nodes"] == m.read("nodes", "p").count() > 2
        (src / "d3.md").write_text(line())
        (src / "a.md").write_text(line())
        (src / "d0.md").unlink()
        before = {r["text"] for t in ("vectors", "labels") for r in m.read(t, "p").collect()}
        m.build(str(src), "p", prune=True)
        new = asked.read_text().splitlines()[len(seen):]
        assert new and len(new) == len(set(new)) and not set(new) & before
        whole = Memory(spark, str(tmp_path / "whole"), embed_with=self.counting(str(tmp_path / "other")))
        whole.build(str(src), "p")
        assert self.held(m) == self.held(whole)

    def test_other_model_embeds_all(self, spark, tmp_path):
        src, asked = tmp_path / "src", tmp_path / "asked"
        src.mkdir()
        (src / "a.md").write_text("Harbour stands beside Granite. Harbour is old and Granite is older.")
        Memory(spark, str(tmp_path / "mem")).build(str(src), "p")
        m = Memory(spark, str(tmp_path / "mem"), embed_with=self.counting(str(asked)))
        m.build(str(src), "p")
        assert {r["model"] for r in m.read("vectors", "p").collect()} == {"counting"} and "Harbour (Concept)" in asked.read_text()
        n = len(asked.read_text().splitlines())
        m.derive("p", anew=True)
        assert len(asked.read_text().splitlines()) == n
