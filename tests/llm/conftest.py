import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def oracle():
    def run(sql):
        db = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = db.execute(sql)
        cols = [c[0] for c in cur.description]
        return sorted(({k: v for k, v in zip(cols, r)} for r in cur.fetchall()), key=repr)

    return run


#: Documents with awkward values: nulls in every column, empty texts, repeated rows, and a column that operators use themselves.
ODD = [
    (1, "Plain words stand here in one line and more words follow them.", "en", "a", 62, "x"),
    (1, "Plain words stand here in one line and more words follow them.", "en", "a", 62, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, None, None, None, None, None),
    (None, "Plain words stand here in one line and more words follow them.", "en", None, 62, "x"),
    (None, None, None, "b", None, None),
    (4, "long " * 30000, "de", "b", 150000, "x"),
    (5, "\n\n \t\n", "fr", "b", 5, "x"),
    (6, "Über straße ñandú \U0001f600 ́ zero", "de", "c", 25, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"


@pytest.fixture()
def odd(spark):
    def make(extra="score", rows=ODD):
        return spark.createDataFrame(rows, SCHEMA.format(extra=extra))

    return make
