from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.register import chunk_view, register
from recollect.operators.chunk import chunks_of


def test_sql_functions(spark):
    assert len(register(spark)) == 6
    row = spark.sql("select norm_key('Acme, Corp.') a, slugify('Hello World!') b, slugify('') c, approx_tokens('12345678901') d, dot_product(array(1D, 2D), array(3D, 4D)) e, node_score(3, 4) f, sequence_ratio('abcd', 'bcde') g").first()
    assert tuple(row) == ("acme corp", "hello-world", "untitled", 2, 11.0, 10, 0.75)
    want = spark.sql("select 'Acme, Corp.' s").select(T.norm_key(F.col("s"))).first()[0]
    assert want == "acme corp"


def test_chunk_view(spark):
    text = "# a\n" + "w " * 50 + "\n# b\n" + "v " * 50
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, body string").createOrReplaceTempView("docs_for_chunks")
    chunk_view(spark, "docs_for_chunks", "chunks_for_sql", size=20, overlap=5)
    got = spark.sql("select id, chunk, text from chunks_for_sql order by id, chunk").collect()
    want = spark.table("docs_for_chunks").where("id = 1").select(chunks_of(F.col("body"), 20, 5)).first()[0]
    assert [r["text"] for r in got] == want and {r["id"] for r in got} == {1}
