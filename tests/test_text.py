import difflib

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.fuzzy import ratio


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name,given,want", [
    ("2026", "Concept", "Milestone"), ("2027-2030+", "Concept", "Milestone"), ("17.8%", "Concept", "Metric"), ("72.0%", "Metric", "Metric"),
    ("ADEX Group", "Organization", "Organization"), ("ISO 9001:2015", "Policy", "Policy"), ("1999 to present", "Event", "Milestone"), ("$12,000", "Concept", "Metric"),
])
def test_refine_type(spark, name, given, want):
    assert one(spark, T.refine_type(F.lit(name), F.lit(given))) == want


def test_sentences(spark):
    for text, want in (("The image shows people on a roof", True), ("a b c d e f g h i j k", True), ("ADEX Group", False), ("Bangladesh Labour Act 2006", False)):
        assert one(spark, T.looks_like_sentence(F.lit(text))) is want


def test_names(spark):
    assert one(spark, T.clean_name(F.lit("  \"*Acme\u00a0 Corp`' "))) == "Acme Corp"
    assert one(spark, T.norm_key(F.lit("Acme, Corp.  (UK)"))) == "acme corp uk"
    assert one(spark, T.slugify(F.lit("Hello World!"))) == "hello-world"
    assert one(spark, T.slugify(F.lit("  Two_words  "))) == "two-words"
    assert one(spark, T.slugify(F.lit(""))) == "untitled"
    assert one(spark, T.norm_type(F.lit(" person "))) == "Person"
    assert one(spark, T.norm_type(F.lit("gadget"))) == "Concept"
    assert one(spark, T.clean_name(F.lit(None).cast("string"))) == ""


def test_stems(spark):
    for file, want in (("a/Report.docx.md", "a/report"), ("report.pdf.md", "report"), ("a/.hidden", "a/.hidden"), ("x.y.z.md", "x.y")):
        assert one(spark, T.stem_key(F.lit(file))) == want


def test_parse_json(spark):
    for text, want in (("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("Sure: {\"a\": [1, 2]} ok", '{"a": [1, 2]}'), ("no json", None), ("", None), ("see [1, 2] there", "[1, 2]")):
        assert one(spark, T.parse_json(F.lit(text))) == want


def test_small_functions(spark):
    assert one(spark, T.version_key(F.lit("v1.10"))) == [1, 10, 0]
    assert one(spark, T.version_key(F.lit(None).cast("string"))) == [0, 0, 0]
    assert [one(spark, T.context_window(F.lit(x))) for x in (0, 8, 16, 64)] == [8192, 4096, 8192, 16384]
    assert one(spark, T.html_safe_json(F.lit("</script>&"))) == "\\u003c/script\\u003e\\u0026"
    assert one(spark, T.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert one(spark, T.approx_tokens(F.lit("x" * 11))) == 2
    got = one(spark, T.node_text(F.lit("A"), F.lit("Person"), F.lit("boss"), F.array(F.lit("B")), F.array(F.lit("f1."))))
    assert got == "A (Person). boss Also known as: B f1."


def test_ratio(spark):
    a, b = "acme corporation", "acme corp"
    assert one(spark, ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_first_words(spark):
    """They are the first of all words, whatever surrounds them."""
    texts = ["", " ", "a", " a b ", "\n\t a\u2003b\x1cc\u00a0d  e f g h i j", "1 2 3 4 5 6 7", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7\n", "é ü\u3000ß", "x" * 100_000, " " * 100_000 + "y", "z " * 50_000, "\U0001f600 \U0001f601", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 7):
        for r in df.select("t", T.first_words(F.col("t"), n).alias("got"), F.slice(T.words(F.col("t")), 1, n).alias("want")).collect():
            assert r["got"] == r["want"] and (r["t"] is None or r["got"] == r["t"].split()[:n])
