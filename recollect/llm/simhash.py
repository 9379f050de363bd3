"""SimHash near-duplicates, found by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.components import connected_components
from recollect.session import Cut, release

#: Links differ in at most this many bits.
RADIUS = 2
#: Buckets up to this size are joined pair by pair; larger ones go through shared one-bit neighbours.
PAIR_BUCKET = 48


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks such that any ``radius`` bits miss one of them altogether.

    Bit i has a label of radius+1 bits; mask v keeps the bits whose label has
    an odd product with v. ``radius`` labels cannot span the label space, so
    some v is orthogonal to all of them: mask v has none of those bits, and two
    words that differ only there agree under it.
    """
    size = 1 << (radius + 1)
    label = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(label[i] & v).count("1") % 2) for v in range(1, size)]


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of the text's 3-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII space count
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= 3:
        return digest(line, 42)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *[e + 1 for e in ends[:-3]]]
    h = np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[2:])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _batches(it):
    for batch in it:
        texts = batch.column("text")
        fp = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("tk"), pa.array(fp)], names=["doc_id", "tk", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, tk, fp)`` for every row; tk is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    return rows.mapInArrow(_batches, "doc_id long, tk long, fp long")


def near_pairs(fps: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all pairs of distinct ``fp`` within RADIUS bits."""
    mask = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in covering_masks()])
    keyed = fps.select("fp", F.posexplode(F.transform(mask, lambda m: m.bitwiseAND(F.col("fp")))).alias("v", "key"))
    sizes = keyed.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = Cut(keyed.join(sizes, ["v", "key"]), "buckets")
    small = held.df.where(F.col("n") <= PAIR_BUCKET).select("v", "key", "fp")
    a, b = small.withColumnRenamed("fp", "src"), small.withColumnRenamed("fp", "dst")
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS
    pairs = a.join(b, ["v", "key"]).where((F.col("src") < F.col("dst")) & near).select("src", "dst")
    # two words within 2 bits share a word within 1 bit of both; at most 65 words lie around each such centre
    large = held.df.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    around = large.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("centre"))
    stars = around.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("f")).where("size(f) > 1")
    stars = stars.select(F.col("f")[0].alias("src"), F.explode(F.slice("f", 2, 65)).alias("dst"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, tk, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Fingerprints of all texts; distinct fingerprints fall into one bucket per
    covering mask, so each pair within 2 bits meets in some bucket; links feed
    the distributed union-find. component_id is the smallest doc_id reachable.
    Equal texts meet as one fingerprint, and no bucket is ever expanded into
    all its pairs beyond PAIR_BUCKET members.

    A text of any length is fingerprinted whole, in memory proportional to it. Null or empty texts have fingerprint 0 and link like any other; null
    doc_ids take part but are never a component's name unless it has no other
    (then it is null); repeated rows come back repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = Cut(fingerprints(docs), "fingerprints")
    release(spark)
    fps = Cut(rows.df.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    comp = connected_components(near_pairs(fps.df))
    named = fps.df.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
    linked = named.where("component is not null")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    found = linked.join(least, "component").select("fp", "component_id")
    alone = named.where("component is null").select("fp", F.col("first").alias("component_id"))
    names = Cut(found.union(alone), "names")
    return rows.df.join(names.df, "fp").select("doc_id", "tk", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose group's first (doc_id, text) they are; columns and other rows' order free.

    A group keeps its smallest doc_id (null ids last); rows repeated whole count once.
    """
    found = Cut(simhash_components(docs), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tk"))
    # without any id in a group, component_id is null: group by fingerprint then, as ids cannot name it
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    best = found.df.groupBy(group.alias("g")).agg(F.min(order).alias("b")).select(F.col("b.doc_id").alias("_d"), F.col("b.tk").alias("_t"))
    keyed = docs.withColumn("_tk", F.xxhash64("text"))
    kept = keyed.join(best.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_tk") == F.col("_t")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_tk"]).select(*docs.columns)
