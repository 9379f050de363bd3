"""Document dedup before extraction: exact content and format variants."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import normal_body, stem_key
from recollect.session import Cut


def document_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with its dedup keys: ``fingerprint``, ``norm_len`` and ``stem``, in place of the body."""
    norm = normal_body(F.col("body"))
    rest = [c for c in docs.columns if c != "body"]
    return docs.select(*rest, F.md5(norm).alias("fingerprint"), F.length(norm).alias("norm_len"), stem_key(F.col("file")).alias("stem"))


def exact_duplicates(docs: DataFrame, least: int = config.DEDUP_EXACT_CHARS) -> DataFrame:
    """Rows of ``document_keys`` with ``duplicate``: an earlier row has the same long enough content."""
    keys = Cut(document_keys(docs), "content-keys").df  # used twice
    first = keys.groupBy("project", "fingerprint").agg(F.min("doc_ord").alias("_first"))
    rows = keys.join(first, ["project", "fingerprint"])
    return rows.withColumn("duplicate", (F.col("norm_len") > least) & (F.col("doc_ord") > F.col("_first"))).drop("_first")


def is_variant(n: int, before: int | None) -> bool:
    """Whether a text of n characters is a variant of the one that its stem's last accepted document has."""
    return bool(n > config.DEDUP_VARIANT_CHARS and before and config.VARIANT_LOW <= n / max(before, 1) <= config.VARIANT_HIGH)


class Lengths:
    """What a run of documents of one stem makes of the length accepted before it, whatever that is.

    Incoming lengths that made every document so far a variant are still there: they form an interval, which shrinks.
    Those that fell out of it at the kth document all became that document's length and went on from there. So the
    function is a list of nested intervals, each with what became of the lengths outside it; where these agree, they are one.
    """

    def __init__(self) -> None:
        self.low, self.high = 1, float("inf")  # lengths in it are unchanged
        self.out: list[list] = []  # [low, high, value]: of lengths outside this interval, but inside those before

    def add(self, n: int) -> None:
        """One more document, which is no copy."""
        for part in self.out:
            if not is_variant(n, part[2]):
                part[2] = n
        low, high = self.low, self.high
        if n <= config.DEDUP_VARIANT_CHARS:
            low, high = 1, 0
        else:
            first, last = math.floor(n / config.VARIANT_HIGH) - 1, math.ceil(n / config.VARIANT_LOW) + 1
            first = next(x for x in range(max(first, 1), first + 4) if is_variant(n, x))
            last = next(x for x in range(last, last - 4, -1) if is_variant(n, x))
            low, high = max(low, first), min(high, last)
        if self.low > self.high:  # nothing is unchanged any more
            pass
        elif self.out and self.out[-1][2] == n:
            self.out[-1][:2] = [low, high]
        elif (low, high) != (self.low, self.high) or not self.out:
            self.out.append([low, high, n])
        if self.low <= self.high:
            self.low, self.high = low, high
        for i in range(len(self.out) - 2, -1, -1):
            if self.out[i][2] == self.out[i + 1][2]:
                del self.out[i]

    def __call__(self, before: int | None) -> int | None:
        for low, high, value in self.out:
            if before is None or not low <= before <= high:
                return value
        return before


def _summaries(pdf: pd.DataFrame) -> pd.DataFrame:
    """A range of documents as its first and last stem and what it does to their lengths."""
    pdf = pdf.sort_values(["project", "stem", "doc_ord"], kind="stable")
    first = last = None
    whole, before = Lengths(), None
    for project, stem, n, copy in zip(pdf["project"], pdf["stem"], pdf["norm_len"], pdf["copy"]):
        if (project, stem) != last:
            first, last, before = first or (project, stem), (project, stem), None
        if copy:
            continue
        if last == first:
            whole.add(int(n))
        elif not is_variant(n, before):
            before = int(n)
    ends = before if first != last else None
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "first": [json.dumps(first)], "last": [json.dumps(last)], "steps": [json.dumps(whole.out)], "ends": [ends]})


def _incoming(summaries: list) -> dict[int, int]:
    """The length that each range's first stem has before it; ranges in order."""
    found, key, state = {}, None, None
    for s in summaries:
        before = state if s["first"] == key else None
        if before is not None:
            found[s["part"]] = before
        if s["first"] == s["last"]:
            over = Lengths()
            over.out = json.loads(s["steps"])
            state = over(before)
        else:
            state = s["ends"]
        key = s["last"]
    return found


def _judged(incoming: dict[int, int]):
    """Whether each document of a range is a variant of the one accepted before it in its stem."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["project", "stem", "doc_ord"], kind="stable")
        now, before, out = None, incoming.get(int(pdf["part"].iloc[0])), []
        for project, stem, n, copy in zip(pdf["project"], pdf["stem"], pdf["norm_len"], pdf["copy"]):
            if (project, stem) != now:
                before = before if now is None else None
                now = (project, stem)
            out.append(is_variant(n, before))
            if not copy and not out[-1]:
                before = int(n)
        return pdf[["project", "file", "doc_ord", "fingerprint", "norm_len", "copy"]].assign(variant=out)

    return run


def document_dedup(docs: DataFrame) -> DataFrame:
    """``(project, file, doc_ord, skipped)``: null for accepted documents, else ``duplicate`` or ``variant``.

    A document is a duplicate if one accepted before it has its content, and a variant if its length is near that of the
    last one accepted in its stem. A skipped document counts for neither, so the rules depend on order. Keys lie in
    ranges of stem and order. What a range does to the length before it is a small function (``Lengths``); their
    composition, a step for each range, tells every range what it begins with, and all are judged at once, so a stem that has
    the whole table is as many tasks as ranges. Which document is the first of its content is assumed and corrected by
    what was judged, until nothing changes: each round settles at least the next document in order that was not, and two
    or three rounds settle all but contrived tables. Keys, not texts, are shuffled.
    """
    plain = Cut(document_keys(docs), "plain-keys")
    skipped = dedup_keys(plain.df)
    plain.drop()
    return skipped


def dedup_keys(keys: DataFrame) -> DataFrame:
    """``document_dedup`` of rows of ``document_keys``, which are read twice: ranges are drawn from a first pass over them."""
    keys = keys.select("project", "file", F.col("doc_ord").cast("long").alias("doc_ord"), "fingerprint", "norm_len", "stem")
    keys = Cut(keys.repartitionByRange("project", "stem", "doc_ord").withColumn("part", F.spark_partition_id()), "document-keys")
    content = ["project", "fingerprint"]
    long = F.col("norm_len") > config.DEDUP_EXACT_CHARS
    shared = Cut(keys.df.where(long).groupBy(*content).agg(F.min("doc_ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    first = shared
    while True:
        rows = keys.df.join(first.df, content, "left").withColumn("copy", F.coalesce(F.col("doc_ord") > F.col("first"), F.lit(False)))
        rows = Cut(rows.drop("first"), "marked")
        # one row a range
        found = rows.df.groupBy("part").applyInPandas(_summaries, "part int, first string, last string, steps string, ends long").orderBy("part").collect()
        judged = rows.df.groupBy("part").applyInPandas(_judged(_incoming(found)), "project string, file string, doc_ord long, fingerprint string, norm_len int, copy boolean, variant boolean")
        judged = Cut(judged, "judged")
        rows.drop()
        # the first of its content that is no variant; without one, none is a copy
        least = judged.df.where(long & ~F.col("variant")).join(shared.df.select(*content), content, "left_semi").groupBy(*content).agg(F.min("doc_ord").alias("first"))
        corrected = Cut(least, "first")
        changed = corrected.df.withColumnRenamed("first", "now").join(first.df, content, "full").where("not (now <=> first)")
        settled = changed.isEmpty()
        if first is not shared:
            first.drop()
        first = corrected
        if settled:
            break
        judged.drop()
    skipped = F.when(F.col("copy"), "duplicate").when(F.col("variant"), "variant")
    for held in (keys, shared, first):
        held.drop()
    return judged.df.select("project", "file", "doc_ord", skipped.alias("skipped"))


def latest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_text(rows: DataFrame, text: str, order: list, within: list[str] | None = None) -> DataFrame:
    """The best row in ``order`` of each text, case and outer space aside."""
    w = Window.partitionBy(*(within or []), F.lower(F.trim(F.col(text)))).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
