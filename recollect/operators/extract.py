"""Extraction: provider answers per chunk to raw entities, relations and facts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import clean_name, computed, norm_type, parse_json
from recollect.session import Cut

CHUNK = ["project", "file", "doc_ord", "chunk"]


class Extractor(Protocol):
    """Turns a chunk into JSON ``{"entities": [], "relations": [], "facts": []}``; may raise."""

    def __call__(self, text: str) -> str: ...


def prompt(text: str, types: list[str] | None = None) -> str:
    """What a language model is asked for a chunk."""
    return (
        "List what this text says as compact JSON with the keys entities, relations and facts.\n"
        f"An entity has name, type (one of {', '.join(types or config.ENTITY_TYPES)}), description (12 words at most) and aliases; "
        "a relation has source, relation (1 to 3 words) and target; a fact has text (22 words at most) and entities.\n"
        f"At most {config.MAX_ENTITIES} entities, {config.MAX_RELATIONS} relations and {config.MAX_FACTS} facts. "
        "Names are short proper nouns; years are Milestones, numbers Metrics. Nothing that the text does not say.\n\n" + text
    )


def run_extractor(chunks: DataFrame, make: Callable[[], Extractor], attempts: int = 3, waits: tuple[float, ...] = (2, 5, 8)) -> DataFrame:
    """``chunks`` with ``response`` and ``error`` from a provider, made once per task and retried per chunk.

    After FAILED_LEAST chunks in a row have failed, a task takes the provider for down and asks no more.
    """
    schema = chunks.drop("text").schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask, streak = make(), 0
        for pdf in batches:
            responses, errors = [], []
            for text in pdf["text"]:
                response, error = None, f"not asked: {streak} chunks in a row had failed" if streak >= config.FAILED_LEAST else None
                for attempt in range(attempts if error is None else 0):
                    try:
                        response, error = ask(text), None
                        break
                    except Exception as e:  # a provider's failure belongs to its chunk
                        error = str(e) or type(e).__name__
                        if attempt + 1 < attempts:
                            time.sleep(waits[min(attempt, len(waits) - 1)] if waits else 0)
                streak = streak + 1 if error is not None else 0
                responses.append(response)
                errors.append(error)
            yield pdf.drop(columns=["text"]).assign(response=responses, error=errors)

    return chunks.mapInPandas(run, schema + ",response:string,error:string")


class _Outcomes(AccumulatorParam):
    """(answers, failures since the last answer), added up in the order in which tasks end."""

    def zero(self, value):
        return (0, 0)

    def addInPlace(self, before, after):
        return (before[0] + after[0], after[1] if after[0] else before[1] + after[1])


class Breaker:
    """Ends a job as soon as FAILED_LEAST chunks in a row have failed over all its tasks.

    Providers made by ``watched`` report how each chunk went, once however often it is tried again. ``cut`` writes a table under
    a job tag; a thread of the driver cancels the tag's jobs once the reports show an outage, so that tasks in line never ask.
    """

    def __init__(self, spark, poll: float = 0.2):
        self.sc, self.poll, self.tag = spark.sparkContext, poll, f"extract-{uuid.uuid4().hex}"
        self.outcomes = self.sc.accumulator((0, 0), _Outcomes())

    def watched(self, make: Callable[[], Extractor]) -> Callable[[], Extractor]:
        outcomes = self.outcomes

        def made() -> Extractor:
            ask, failed = make(), [None]

            def heard(text: str) -> str:
                try:
                    answer = ask(text)
                except Exception:
                    if failed[0] is not text:
                        failed[0] = text
                        outcomes.add((0, 1))
                    raise
                failed[0] = None
                outcomes.add((1, 0))
                return answer

            return heard

        return made

    @property
    def open(self) -> bool:
        return self.outcomes.value[1] >= config.FAILED_LEAST

    def cut(self, df: DataFrame, name: str) -> Cut:
        over = threading.Event()

        def watch() -> None:
            while not over.wait(self.poll):
                if self.open:
                    self.sc.cancelJobsWithTag(self.tag)
                    return

        thread = threading.Thread(target=watch, daemon=True)
        self.sc.addJobTag(self.tag)
        thread.start()
        try:
            return Cut(df, name)
        except Exception as e:
            if self.open:
                raise RuntimeError(f"{self.outcomes.value[1]} chunks in a row failed; the extractor seems to be down") from e
            raise
        finally:
            over.set()
            thread.join()
            self.sc.removeJobTag(self.tag)


def run_offline(chunks: DataFrame) -> DataFrame:
    """``chunks`` answered by a provider of Columns, for use without a model; answers are typed, not JSON text.

    Entities are the chunk's capitalised words of five letters or more, relations link each
    to the next, facts are the first sentences.
    """
    # whole tokens between these; one pass over the text, in place of a list of all its tokens
    mark = r"[^\s.,;:!?()\"'|#$%&*]"
    found = F.regexp_extract_all("text", F.lit(rf"(?<!{mark})[A-Z][a-z]{{4,}}+[\x85\u2028\u2029]?(?!{mark})"), F.lit(0))
    names = F.slice(F.array_distinct(found), 1, config.MAX_ENTITIES)
    sentences = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 8)
    rows = computed(chunks, _names=names, _said=F.slice(sentences, 1, config.MAX_FACTS))
    none = F.array().cast("array<string>")
    ents = F.transform("_names", lambda n: F.struct(n.alias("name"), F.lit("Concept").alias("type"), F.lit("").alias("description"), none.alias("aliases")))
    pairs = F.transform(F.slice("_names", 2, config.MAX_ENTITIES), lambda n, i: F.struct(F.get("_names", i).alias("source"), F.lit("precedes").alias("relation"), n.alias("target")))
    facts = F.transform("_said", lambda s: F.struct(s.alias("text"), F.filter("_names", lambda n: F.contains(s, n)).alias("entities")))
    return rows.select(*[c for c in chunks.columns if c != "text"], F.lit(None).cast("string").alias("error"), F.lit(True).alias("parse_ok"), ents.alias("_e"), pairs.alias("_r"), facts.alias("_f"))


def _objects(name: str, schema: str) -> Column:
    """Members of a list that are objects."""
    return F.transform(F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: x.startswith("{")), lambda x: F.from_json(x, schema))


def _typed(answers: DataFrame) -> DataFrame:
    """JSON answers as lists of entities, relations and facts; members that are not what they should be are left out."""
    rows = computed(answers, _json=parse_json(F.col("response")))
    rows = computed(rows, _p=F.from_json("_json", "entities array<string>, relations array<string>, facts array<string>"))
    rows = rows.withColumn("parse_ok", F.coalesce(F.col("_json").startswith("{") & F.col("_p").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"_pe": F.col("_p.entities"), "_pr": F.col("_p.relations"), "_pf": F.col("_p.facts")})
    fact = lambda x: F.when(x.startswith("{"), F.from_json(x, "text string, entities array<string>")).otherwise(F.struct(x.alias("text"), F.array().cast("array<string>").alias("entities")))
    return computed(
        rows, _e=_objects("_pe", "name string, type string, description string, aliases array<string>"), _r=_objects("_pr", "source string, relation string, target string"),
        _f=F.transform(F.coalesce("_pf", F.array().cast("array<string>")), fact),
    )


def parse_responses(answers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per answer with its valid ``entities``, ``relations`` and ``facts``, capped; ``parse_ok`` tells unusable answers.

    ``keep`` names columns of the answers to carry along.

    Answers are JSON text in ``response`` or typed lists (see ``run_offline``). Everything happens within the row, so nothing is shuffled.
    """
    cleaned = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), clean_name), lambda x: x != "")
    rows = _typed(answers) if "response" in answers.columns else answers
    ents = F.transform("_e", lambda e: F.struct(clean_name(e["name"]).alias("name"), norm_type(e["type"]).alias("type"), F.substring(clean_name(e["description"]), 1, 240).alias("description"), cleaned(e["aliases"]).alias("aliases")))
    rels = F.transform("_r", lambda r: F.struct(clean_name(r["source"]).alias("source"), F.substring(clean_name(r["relation"]), 1, 60).alias("relation"), clean_name(r["target"]).alias("target")))
    facts = F.transform("_f", lambda f: F.struct(F.substring(clean_name(f["text"]), 1, 240).alias("text"), F.slice(cleaned(f["entities"]), 1, 8).alias("entities")))
    rows = computed(rows, _clean=ents, _rels=rels, _facts=facts)
    # names in lower case once, beside what they belong to
    lower = F.transform("_clean", lambda e: F.struct(F.lower(e["name"]).alias("k"), e.alias("e")))
    rows = computed(rows, _all=F.filter(lower, lambda x: F.length(x["e"]["name"]).between(1, 120)))
    rows = computed(rows, _k=F.transform("_all", lambda x: x["k"]))
    own = F.transform(
        F.filter("_all", lambda x, i: F.array_position("_k", x["k"]) == i + 1),
        lambda x: F.struct(x["e"]["name"].alias("name"), x["e"]["type"].alias("type"), x["e"]["description"].alias("description"), F.slice(F.filter(x["e"]["aliases"], lambda a: F.lower(a) != x["k"]), 1, 6).alias("aliases")),
    )
    rows = computed(rows, _own=own)
    rows = computed(rows, _known=F.concat(F.col("_k"), F.flatten(F.transform("_own", lambda e: F.transform(e["aliases"], lambda a: F.lower(a))))))
    ends = F.transform("_rels", lambda r: F.struct(r.alias("r"), F.lower(r["source"]).alias("s"), F.lower(r["target"]).alias("t")))
    ends = F.filter(ends, lambda x: (x["s"] != "") & (x["r"]["relation"] != "") & (x["t"] != "") & (x["s"] != x["t"]))
    rels = F.transform(ends, lambda x: F.struct(x["r"]["source"].alias("source"), x["r"]["relation"].alias("relation"), x["r"]["target"].alias("target"), (F.array_contains("_known", x["s"]) & F.array_contains("_known", x["t"])).alias("grounded")))
    return rows.select(
        *CHUNK, *keep, "error", "parse_ok", F.slice("_own", 1, config.MAX_ENTITIES).alias("entities"), F.slice(rels, 1, config.MAX_RELATIONS).alias("relations"),
        F.slice(F.filter("_facts", lambda f: F.length(f["text"]) >= 8), 1, config.MAX_FACTS).alias("facts"),
    )


def clean_documents(parsed: DataFrame) -> DataFrame:
    """Rows of the documents all of whose chunks were answered; others are left for the next run whole."""
    failed = parsed.where("error is not null").select("project", "file").distinct()
    return parsed.join(failed, ["project", "file"], "left_anti")


def check_provider(parsed: DataFrame) -> tuple[int, int]:
    """Numbers of chunks and of failed ones; fail where so many did that the provider must be down."""
    n, bad = parsed.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())).first()
    if bad >= config.FAILED_LEAST and bad >= config.FAILED_SHARE * n:
        raise RuntimeError(f"{bad} of {n} chunks failed; the extractor seems to be down")
    return n, bad


def raw_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw entities, relations and facts; ``seq`` sorts by document, chunk and place."""

    def table(name: str, *cols: str) -> DataFrame:
        seq = F.col("doc_ord") * (1 << 24) + F.col("chunk") * (1 << 8) + F.col("_i")
        return parsed.select(*CHUNK, F.posexplode(name).alias("_i", "_x")).select("project", seq.cast("bigint").alias("seq"), *[F.col(f"_x.{c}") for c in cols], "file", "chunk")

    return (
        table("entities", "name", "type", "description", "aliases"),
        table("relations", "source", "relation", "target", "grounded"),
        table("facts", "text", "entities"),
    )


def extract_stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("project").agg(
        F.count_distinct("file").alias("docs"), F.count(F.lit(1)).alias("chunks"),
        F.sum(F.size("entities")).cast("bigint").alias("raw_entities"), F.sum(F.size("relations")).cast("bigint").alias("raw_relations"), F.sum(F.size("facts")).cast("bigint").alias("raw_facts"),
    )
