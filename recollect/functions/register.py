"""The text rules as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from recollect.functions.fuzzy import ratio
from recollect.operators.chunk import chunk_documents

#: name -> (parameters, return type, expression); the expressions are those of ``text``.
SQL_FUNCTIONS = {
    "norm_key": ("s STRING", "STRING", "trim(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', ' '))"),
    "slugify": ("s STRING", "STRING", r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), r'(?U)[^\w\s-]', ''), r'(?U)[\s_-]+', '-'), '^-+|-+$', ''), ''), 'untitled')"),
    "approx_tokens": ("s STRING", "BIGINT", "cast(floor(length(s) / 4) as bigint)"),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, x) -> t + x)"),
    "node_score": ("degree BIGINT, mentions BIGINT", "BIGINT", "2 * degree + mentions"),
}


def chunk_view(spark: SparkSession, table: str, name: str, text: str = "body", size: int | None = None, overlap: int | None = None) -> None:
    """A view of a table's chunks for SQL: ``text`` becomes a row for each chunk, with its number; other columns stay."""
    chunk_documents(spark.table(table), size, overlap, None, text).createOrReplaceTempView(name)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL; returns their names."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark.udf.register("sequence_ratio", ratio)
    return [*SQL_FUNCTIONS, "sequence_ratio"]
