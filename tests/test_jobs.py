"""The jobs: two runs over growing input, reruns, broken runs, configs, and their SQL."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import entity_index, stream_memory
from jobs.common import settings
from jobs.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def compare(spark, name, tmp_path):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    db.execute(f"create table a as select * from '{tmp_path}/out/*.parquet'")
    db.execute(f"create table b as {ORACLE[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in db.execute("describe a").fetchall())
    assert db.execute("select count(*) from a").fetchall()[0][0] > 0
    for x, y in (("a", "b"), ("b", "a")):
        assert db.execute(f"select {cols} from {x} except all select {cols} from {y} limit 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name, tmp_path):
    compare(spark, name, tmp_path)


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"overlap": 5}))
    assert settings({"overlap": 1, "size": 2}, str(path)) == {"overlap": 5, "size": 2}
    path.write_text(json.dumps({"overlpa": 5}))
    with pytest.raises(ValueError, match="overlpa"):
        settings({"overlap": 1}, str(path))


DOCS = "doc_id long, text string, source string, extra string"


def put(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def state(spark, out):
    rows = stream_memory.memory(spark, out).collect()
    return sorted((r["doc_id"] is None, r["doc_id"], r["project"], r["chunk"], r["text"], r["batch"]) for r in rows)


class TestStream:
    FIRST = [
        (1, "Gantry Castle opens the River gate.", "a", "x"), (2, "Morning Bells ring over Harbour town.", "a", "x"), (2, "Morning Bells ring over Harbour town.", "a", "x"),
        (3, "", "b", None), (4, None, None, None), (None, "Nameless Texts stay with their content.", "b", "x"),
    ]
    SECOND = [
        (1, "Gantry Castle closes the River gate.", "a", "x"), (2, "Morning Bells ring over Harbour town.", "a", "x"), (5, "Entirely fresh Words arrive here today.", "c", "x"),
        (4, "Finally Some words for number four.", None, "x"), (None, "Nameless Texts stay with their content.", "b", "x"),
    ]

    def test_two_runs_over_growing_input(self, spark, tmp_path):
        docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
        put(spark, docs, self.FIRST)
        assert stream_memory.run(spark, docs, out, mark) == {"rows_read": 6, "documents": 5}
        first = state(spark, out)
        assert [(r[1], r[2]) for r in first] == [(1, "a"), (2, "a"), (None, "b")]
        # nothing new: nothing is read, nothing changes
        assert stream_memory.run(spark, docs, out, mark) == {"rows_read": 0, "documents": 5}
        assert state(spark, out) == first
        put(spark, docs, self.SECOND)
        assert stream_memory.run(spark, docs, out, mark) == {"rows_read": 5, "documents": 6}
        second = state(spark, out)
        assert [(r[1], r[2], r[4].split()[2]) for r in second] == [(1, "a", "closes"), (2, "a", "ring"), (4, "unknown", "words"), (5, "c", "Words"), (None, "b", "stay")]
        # what did not change keeps the batch it came with
        assert {r[1]: r[5] for r in second} == {1: 1, 2: 0, 4: 1, 5: 1, None: 0}
        # a text that goes back to an older version counts as changed again
        put(spark, docs, self.FIRST[:1])
        stream_memory.run(spark, docs, out, mark)
        assert state(spark, out)[0][4].split()[2] == "opens"
        # one run over everything knows the same documents
        whole = str(tmp_path / "whole")
        assert stream_memory.run(spark, docs, whole, str(tmp_path / "mark2"))["documents"] == 6

    def test_batch_again(self, spark, tmp_path):
        """A batch that runs twice, as after a failure between its writes, leaves what one run leaves."""
        out = str(tmp_path / "out")
        put(spark, str(tmp_path / "docs"), self.FIRST)
        put(spark, str(tmp_path / "docs2"), self.SECOND)
        step = stream_memory.take(out, stream_memory.DEFAULTS)
        batch = lambda n: stream_memory.shaped(spark.read.schema(DOCS).parquet(str(tmp_path / n)))
        step(batch("docs"), 0)
        step(batch("docs2"), 1)
        want = state(spark, out)
        step(batch("docs2"), 1)
        assert state(spark, out) == want
        step(batch("docs").limit(0), 2)
        assert state(spark, out) == want
        assert len(want) == len(set(want))

    def test_stops_between_writes(self, spark, tmp_path, monkeypatch):
        """A run that breaks off after its passages and before its manifest; the next run does that batch again."""
        docs, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
        put(spark, docs, self.FIRST)
        stream_memory.run(spark, docs, out, mark)
        put(spark, docs, self.SECOND)
        write = stream_memory.overwrite

        def broken(rows, path, *by):
            if path.endswith("manifest"):
                raise OSError("disk gone")
            write(rows, path, *by)

        monkeypatch.setattr(stream_memory, "overwrite", broken)
        with pytest.raises(Exception, match="disk gone"):
            stream_memory.run(spark, docs, out, mark)
        monkeypatch.undo()
        assert stream_memory.run(spark, docs, out, mark) == {"rows_read": 5, "documents": 6}
        put(spark, str(tmp_path / "docs2"), self.FIRST)
        stream_memory.run(spark, str(tmp_path / "docs2"), str(tmp_path / "out2"), str(tmp_path / "mark2"))
        put(spark, str(tmp_path / "docs2"), self.SECOND)
        stream_memory.run(spark, str(tmp_path / "docs2"), str(tmp_path / "out2"), str(tmp_path / "mark2"))
        assert state(spark, out) == state(spark, str(tmp_path / "out2"))

    def test_parts_equal_the_whole(self, spark, tmp_path):
        """The table in four files and two runs gives the passages that one run over one file gives."""
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        at = lambda n: str(tmp_path / n)
        docs.where("doc_id % 3 = 0").repartition(2).write.parquet(at("docs"))
        conf = tmp_path / "c.json"
        conf.write_text(json.dumps({"files_per_batch": 1}))
        stream_memory.run(spark, at("docs"), at("out"), at("mark"), str(conf))
        docs.where("doc_id % 3 <> 0").repartition(2).write.mode("append").parquet(at("docs"))
        stream_memory.run(spark, at("docs"), at("out"), at("mark"), str(conf))
        stream_memory.run(spark, f"{SF}/documents.parquet", at("out1"), at("mark1"))
        a, b = (stream_memory.memory(spark, at(n)).drop("batch") for n in ("out", "out1"))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert stream_memory.memory(spark, at("out")).select("batch").distinct().count() == 4


class TestIndex:
    DOCS = [(i, f"Castle Harbour and the Castle number {i % 4} of Meadow{'x' * (i % 2)} lands.", "ab"[i % 2], "x") for i in range(12)] + [(50, None, None, None), (51, "", "b", None), (None, "Unknown Harbour without any id.", None, "x")]

    def test_index(self, spark, tmp_path):
        put(spark, str(tmp_path / "docs"), self.DOCS + self.DOCS[:3])
        run = lambda: entity_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
        assert run() == {"projects": 3, "entities": 8}
        rows = lambda: sorted(map(tuple, entity_index.read_index(spark, str(tmp_path / "out")).collect()), key=str)
        first = rows()
        found = {(r[-1], r[0]): r for r in first}
        assert found[("a", "castle")][2:] == (6, 6, 1, 8, 0, 1, "a")
        assert found[("unknown", "harbour")][7] == 2
        assert run() == {"projects": 3, "entities": 8} and rows() == first

    def test_some_projects(self, spark, tmp_path):
        docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
        put(spark, docs, self.DOCS)
        entity_index.run(spark, docs, out)
        before = entity_index.read_index(spark, out).where("project <> 'a'").collect()
        put(spark, docs, [(90, "Castle Rampart and Harbour again.", "a", "x")])
        conf = tmp_path / "c.json"
        conf.write_text(json.dumps({"projects": ["a"]}))
        entity_index.run(spark, docs, out, str(conf))
        after = entity_index.read_index(spark, out)
        assert sorted(map(str, after.where("project <> 'a'").collect())) == sorted(map(str, before))
        assert after.where("project = 'a' and entity = 'rampart'").count() == 1

    def test_long_copies_count_once(self, spark, tmp_path):
        text = "Castle Harbour words go on and on. " * 20
        put(spark, str(tmp_path / "docs"), [(i, text, "a", "x") for i in range(5)] + [(9, text, "b", "x")])
        entity_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
        assert {(r["project"], r["documents"]) for r in entity_index.read_index(spark, str(tmp_path / "out")).where("entity = 'castle'").collect()} == {("a", 1), ("b", 1)}

    def test_empty(self, spark, tmp_path):
        put(spark, str(tmp_path / "docs"), [])
        assert entity_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out")) == {"projects": 0, "entities": 0}


def test_command_line(spark, tmp_path):
    """The command line makes a session of its own and prints the counts."""
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").write.parquet(str(tmp_path / "docs"))
    args = ["--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run([sys.executable, "-m", "jobs.stream_memory", *args], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert json.loads(done.stdout.splitlines()[-1]) == {"rows_read": 20, "documents": 20}, done.stderr[-2000:]
    assert "batch 0: read 20 rows" in done.stderr
