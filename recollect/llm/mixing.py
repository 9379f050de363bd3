"""Mixing sources to target weights by Poisson replication (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import unit_hash

#: Highest mean that is drawn at once; ``exp(-rate)`` of higher ones would leave the range of doubles.
MOST_RATE = 500
#: Sources up to this many have their rates broadcast (about 4 MB); beyond, rates are joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, alpha: float) -> DataFrame:
    """``(source, n, rate)``: mean repetitions that bring each source to its share.

    ``weights`` gives shares by source (they are normalised; a source that it
    lacks gets 0). Without it the share is proportional to ``n ** alpha``.
    ``total`` is the expected number of output rows, the input's by default.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    n = n.withColumn("share", share)
    sums = n.agg(F.sum("share").alias("share"), F.sum("n").alias("n")).first()
    all_share, out = float(sums["share"] or 0.0), float(sums["n"] or 0) if total is None else float(total)
    return n.select("source", "n", (F.col("share") * F.lit(out) / F.lit(all_share) / F.col("n") if all_share > 0 else F.lit(0.0)).alias("rate"))


def poisson_count(u: Column, rate: Column, terms: Column) -> Column:
    """Invert the Poisson distribution: the number of k whose CDF lies at or below u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"), (F.exp(-rate) <= u).alias("go"))
    step = lambda s, i: F.when(
        s["go"],
        F.struct(
            (s["p"] * rate / i).alias("p"),
            (s["cdf"] + s["p"] * rate / i).alias("cdf"),
            i.cast("int").alias("k"),
            (s["cdf"] + s["p"] * rate / i <= u).alias("go"),
        ),
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["k"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, alpha: float = 0.5, seed: int = 17) -> DataFrame:
    """Replicate documents so that sources meet their weights, in a global random order.

    Each row gets a Poisson number of copies whose mean is its source's rate.
    The number comes from a hash of (seed, doc_id), so reruns, other
    partitionings and lost executors give the same rows. A rate above MOST_RATE
    is drawn as the sum of equal Poisson parts, each from a hash of its own.

    Columns: those of ``docs`` (they win over clashing names: an incoming
    ``copy``, ``n_copies`` or ``shuffle_key`` is replaced), then ``copy`` (from 0),
    ``n_copies`` and ``shuffle_key``. Rows are dealt by ``shuffle_key`` and sorted
    by it within partitions, so any prefix of a partition is a fair mix.
    Null source is a source of its own; a null doc_id counts by its text, and
    repeated rows get the same number of copies; text, also null or very long, is carried along. An empty table
    gives an empty result; n_copies 0 leaves the result.
    """
    own = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    docs = docs.select(*own)
    rates = source_rates(docs, weights, total, alpha).select(F.col("source").alias("_s"), F.col("rate").alias("_rate"))
    known = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rated = docs.join(F.broadcast(rates) if known else rates, F.col("source").eqNullSafe(F.col("_s")))
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit(""))))
    parts = F.ceil(F.col("_rate") / MOST_RATE).cast("int")
    each = F.when(parts > 1, F.col("_rate") / parts).otherwise(F.col("_rate"))
    # beyond this many terms the tail weighs less than the 2**-49 that the hash can tell apart
    terms = (each + 12 * F.sqrt(each) + 40).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + poisson_count(unit_hash(F.lit(seed), who, i), each, terms))
    n = F.when(parts > 1, many).otherwise(poisson_count(unit_hash(F.lit(seed), who), each, terms))
    drawn = rated.select(*own, n.alias("n_copies")).where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "copy", "text"))
    return keyed.select(*own, "copy", "n_copies", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: DuckDB's form of ``mix`` with its defaults over {docs}; without shuffle_key, whose hash SQL lacks.
MIX_SQL = """
with recursive n as (select source, count(*) as n from {docs} group by source),
r as (select source, sqrt(n::double) * (select sum(n) from n)::double / (select sum(sqrt(n::double)) from n) / n as rate from n),
u as (select d.*, r.rate, (('0x' || substr(md5('17:' || coalesce(cast(d.doc_id as varchar), 'null:' || coalesce(md5(d.text), ''))), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
      from {docs} d join r on d.source is not distinct from r.source),
k as (select distinct source, rate, 0 as k, exp(-rate) as p, exp(-rate) as cdf from r
      union all select source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from k where k < (rate + 12 * sqrt(rate) + 40)),
c as (select source, list(cdf order by k) as cdfs from k group by source),
m as (select u.*, len(list_filter(c.cdfs, lambda x: x <= u.u)) as n_copies from u join c on u.source is not distinct from c.source)
select doc_id, text, lang, source, n_chars, cast(unnest(range(n_copies)) as int) as copy, cast(n_copies as int) as n_copies from m where n_copies > 0
"""
