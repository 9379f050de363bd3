"""Entity resolution: aliases, votes, near-duplicate merge, node ids."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.fuzzy import most_ratio, ratio
from recollect.functions.text import is_junk, norm_key, refine_type, slugify, strip
from recollect.operators.components import connected_components
from recollect.operators.similar import near_pairs
from recollect.operators.vectors import Embedded
from recollect.session import Cut


def mentions_of(raw_entities: DataFrame) -> DataFrame:
    """Entities that count, with their normalised name ``nm``."""
    return raw_entities.where(~is_junk(F.coalesce("name", F.lit("")))).withColumn("nm", norm_key(F.col("name")))


def alias_parents(mentions: DataFrame) -> DataFrame:
    """``(project, alias, parent, surface)``: the aliases that count and the name each stands for.

    An alias counts if its first claim comes before any entity of that name
    does. The first claimant wins; that it must come earlier makes chains of aliases end.
    """
    claims = mentions.select("project", "seq", F.col("nm").alias("parent"), F.posexplode("aliases").alias("at", "a")).withColumn("alias", norm_key(F.col("a")))
    claims = claims.where((F.col("alias") != "") & (F.col("alias") != F.col("parent")))
    first = claims.groupBy("project", "alias").agg(F.min(F.struct("seq", "at", "parent", strip(F.col("a")).alias("surface"))).alias("c"))
    named = mentions.groupBy("project", F.col("nm").alias("alias")).agg(F.min("seq").alias("first_mention"))
    kept = first.join(named, ["project", "alias"], "left").where(F.col("first_mention").isNull() | (F.col("c.seq") < F.col("first_mention")))
    return kept.select("project", "alias", "c.parent", "c.surface")


def chase(parents: DataFrame) -> DataFrame:
    """``(project, alias, root, surface, parent)``: each alias's end of chain, by pointer jumping."""
    held = Cut(parents.withColumn("root", F.col("parent")), "alias")
    while True:
        up = held.df.select("project", F.col("alias").alias("root"), F.col("root").alias("next"))
        new = Cut(held.df.join(up, ["project", "root"], "left").select("project", "alias", F.coalesce("next", "root").alias("root"), "surface", "parent", F.col("next").isNotNull().alias("_moved")), "alias")
        held.drop()
        held = new
        if held.df.where("_moved").isEmpty():
            return held.df.drop("_moved")


def _votes(rows: DataFrame, value: str, place: Column | None = None) -> DataFrame:
    """Counts of a value by node, with the place that breaks ties: the member's rank in its group, then first sight.

    Where all ranks are equal, the first sight alone is a ``place``, by which Spark counts without sorting.
    """
    place = F.struct("rank", "seq") if place is None else place
    per = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy("project", "key", F.col(value).alias("value"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def top_types(votes: DataFrame) -> DataFrame:
    """The most voted type; Concept only where nothing else was voted for."""
    best = F.min(F.struct((F.col("value") == "Concept").alias("c"), (-F.col("n")).alias("less"), "first", "value"))
    return votes.groupBy("project", "key").agg(best["value"].alias("type"))


def modes(votes: DataFrame, name: str) -> DataFrame:
    """The most frequent value, ties to the first seen."""
    return votes.groupBy("project", "key").agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "value"))["value"].alias(name))


def top_values(votes: DataFrame, name: str, most: int) -> DataFrame:
    w = Window.partitionBy("project", "key").orderBy(F.desc("n"), "first")
    best = votes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return best.groupBy("project", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias(name))


def near_duplicates(canon: DataFrame, embed: Callable[[Column], Column], cosine: float, least_ratio: float, known: DataFrame | None = None, keep: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``(project, key, rep)`` for entities that merge with others.

    Labels closer than ``cosine`` whose names are similar, or contain each other, are linked;
    the member with most mentions (the earliest, if several) stands for its component. ``known(text, vec)`` are vectors of
    labels that need not be embedded again; ``keep`` is given ``(project, text, vec)`` of all labels, for the next time.
    """
    labels = canon.select("project", "key", "ord", "mentions", F.lower("name").alias("low"), F.concat("name", F.lit(" ("), "top", F.lit(")")).alias("text"))
    labels = Embedded(embed, known).attach(labels, F.col("text"))
    labels = Cut(labels.withColumn("id", F.xxhash64("project", "key")), "labels").df
    if keep is not None:
        keep(labels.select("project", "text", "vec"))
    pairs = near_pairs(labels.select("project", "id", "ord", "vec"), cosine)
    a = labels.select(F.col("id").alias("a"), F.col("low").alias("la"))
    b = labels.select(F.col("id").alias("b"), F.col("low").alias("lb"))
    named = Cut(pairs.join(a, "a").join(b, "b"), "named").df
    within = F.contains("la", F.col("lb")) | F.contains("lb", F.col("la"))
    # likeness only for pairs that the cheap rule leaves and whose bound reaches it
    reach = most_ratio(F.col("la"), F.col("lb")) >= least_ratio
    alike = named.where(within).unionByName(named.where(~within & reach).where(ratio("la", "lb") >= least_ratio))
    comp = connected_components(alike.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = labels.join(comp.select(F.col("node").alias("id"), "component"), "id")
    w = Window.partitionBy("project", "component").orderBy(F.desc("mentions"), "ord")
    return members.withColumn("rank", F.row_number().over(w) - 1).withColumn("rep", F.first("key").over(w)).withColumn("at", F.min("ord").over(Window.partitionBy("project", "component"))).select("project", "key", "rep", "rank", "at")


def assign_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``id``: the name's slug, numbered from 2 where it is taken, in order.

    Numbered ids can clash only with slugs that end in numbers themselves (see ``_numbered``); all others are ranked.
    Names without letters or digits share one slug; empty tables give none; rows that are equal but for their key are numbered.
    """
    base = F.substring(slugify(F.col("name")), 1, 48)
    rows = nodes.withColumn("base", F.when(base == "", F.lit("n")).otherwise(base))
    rows = Cut(rows.withColumn("family", F.regexp_replace("base", r"(-[0-9]+)+$", "")).select("project", "key", "ord", "base", "family"), "slugs").df
    sizes = rows.groupBy("project", "base", "family").agg(F.count(F.lit(1)).alias("n"))
    taken = sizes.where("n > 1").select("project", F.col("base").alias("stem"))
    # a slug that looks like a numbered one of a name that does get numbers
    clash = sizes.where(r"base rlike '-[0-9]+$'").select("project", "family", F.regexp_replace("base", r"-[0-9]+$", "").alias("stem"))
    mixed = clash.join(taken, ["project", "stem"], "left_semi").select("project", "family").distinct()
    w = Window.partitionBy("project", "base").orderBy("ord")
    easy = rows.join(mixed, ["project", "family"], "left_anti").withColumn("r", F.row_number().over(w))
    easy = easy.select("project", "key", F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("r").cast("string"))).alias("id"))
    return nodes.join(easy.union(_numbered(rows.join(mixed, ["project", "family"], "left_semi"))), ["project", "key"])


def _numbered(rows: DataFrame) -> DataFrame:
    """``(project, key, id)`` of rows whose numbered slugs meet other slugs.

    Call report the stem of report-7. The id report-7 can be claimed by the stem's seventh or by the first row whose own slug it is,
    by nobody else. So slugs are settled level by level, by how many numbers they end in. At each level:

    * A number is lost to the stem if its slug's first row comes before the stem gets there. Taken in order of numbers, number k is lost if
      fewer than ``k - 1 - c`` smaller ones are, where c of the stem's numbered rows come before that first row.
    * The stem's i-th numbered row gets the i-th number of those that are left: i + 1 and the lost ones before it, of which the
      r-th, with number b, counts from i = b - r on.
    * A slug whose number is not lost to its stem has lost its own first id, and all its rows are numbered.

    Windows rank and count; only the numbers of a stem's slugs, a row each, are gone through in order.
    """
    depth = F.size(F.regexp_extract_all(F.regexp_extract("base", r"(-[0-9]+)*$", 0), F.lit("-"), F.lit(0)))
    rows = Cut(rows.select("project", "key", "ord", "base", depth.alias("depth")), "clashing").df
    numbered = r"^(.+)-([2-9]|[1-9][0-9]{1,8})$"
    firsts = rows.groupBy("project", "base").agg(F.min("ord").alias("ord"))
    slugs = firsts.where(F.col("base").rlike(numbered)).select("project", F.regexp_extract("base", numbered, 1).alias("stem"), F.regexp_extract("base", numbered, 2).cast("long").alias("k"), "ord")
    lost_by = rows.sparkSession.createDataFrame([], "project string, base string, kept boolean")
    done, deepest = None, rows.agg(F.max("depth")).first()[0]

    def lost(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n, found = pdf.sort_values("k"), 0, []
        for room in (pdf["k"] - 1 - pdf["c"]).tolist():
            found.append(n < room)
            n += found[-1]
        return pdf[["project", "stem", "k"]].assign(lost=found)

    for level in range((deepest if deepest is not None else -1) + 1):
        here = rows.where(F.col("depth") == level).join(lost_by, ["project", "base"], "left")
        rank = F.row_number().over(Window.partitionBy("project", "base").orderBy("ord"))
        # i: 0 for the row that has the slug itself, then from 1 on
        here = Cut(here.select("project", "key", "ord", "base", (rank - F.coalesce("kept", F.lit(True)).cast("int")).cast("long").alias("i")), "level").df
        mine = slugs.join(here.select("project", F.col("base").alias("stem")).distinct(), ["project", "stem"], "left_semi")
        events = here.where("i > 0").select("project", F.col("base").alias("stem"), "ord", F.lit(None).cast("long").alias("k")).unionByName(mine)
        before = F.count_if(F.col("k").isNull()).over(Window.partitionBy("project", "stem").orderBy("ord"))
        counted = events.withColumn("c", before).where("k is not null").select("project", "stem", "k", "c")
        judged = Cut(counted.groupBy("project", "stem").applyInPandas(lost, "project string, stem string, k long, lost boolean"), "judged").df
        lost_by = judged.select("project", F.concat_ws("-", "stem", F.col("k").cast("string")).alias("base"), F.col("lost").alias("kept"))
        r = F.row_number().over(Window.partitionBy("project", "base").orderBy("k"))
        gaps = judged.where("lost").select("project", F.col("stem").alias("base"), "k").select("project", F.lit(None).cast("string").alias("key"), "base", (F.col("k") - r).alias("i"))
        placed = here.select("project", "key", "base", "i").unionByName(gaps)
        skipped = F.count_if(F.col("key").isNull()).over(Window.partitionBy("project", "base").orderBy("i", F.col("key").isNotNull()))
        number = F.col("i") + 1 + F.col("_g")
        ids = placed.withColumn("_g", skipped).where("key is not null").select("project", "key", F.when(F.col("i") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string"))).alias("id"))
        done = ids if done is None else done.union(ids)
    return done if done is not None else rows.select("project", "key", F.col("base").alias("id"))


def resolve(raw_entities: DataFrame, embed: Callable[[Column], Column] | None = None, cosine: float = config.MERGE_COSINE, least_ratio: float = config.MERGE_RATIO, known: DataFrame | None = None, keep: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (without degree and facts) and ``resolution(project, norm_key, node_id)``.

    ``embed`` maps a text Column to a vector Column; without it only names and aliases merge. ``known`` and ``keep`` are those of ``near_duplicates``.
    """
    mentions = Cut(mentions_of(raw_entities), "mentions").df
    aliases = chase(alias_parents(mentions))
    roots = aliases.select("project", F.col("alias").alias("nm"), "root")
    keyed = mentions.join(roots, ["project", "nm"], "left").withColumn("own", F.coalesce("root", "nm")).drop("root")
    canon = keyed.groupBy("project", F.col("own").alias("key")).agg(F.min("seq").alias("ord"), F.min_by("name", "seq").alias("name"), F.count(F.lit(1)).alias("mentions"))
    if embed is None:  # every name stands for itself
        base, merged, place = Cut(canon, "named").df, None, F.col("seq")
        rows = Cut(keyed.select("project", F.col("own").alias("key"), "seq", "type", "description", "file"), "voted").df
        claimed = aliases.select("project", F.col("root").alias("key"), "surface").join(base.select("project", "key"), ["project", "key"])
    else:
        first = keyed.select("project", F.col("own").alias("key"), "type", "seq", F.lit(0).alias("rank"))
        tops = modes(_votes(first, "type"), "top")
        labelled = canon.join(tops, ["project", "key"], "left").fillna("Concept", ["top"])
        near = near_duplicates(labelled, embed, cosine, least_ratio, known, keep)
        merged = canon.select("project", "key", "ord").join(near, ["project", "key"], "left").select("project", "key", F.coalesce("rep", "key").alias("rep"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("at", "ord").alias("at"))
        merged, place = Cut(merged, "merged").df, None
        rows = keyed.join(merged.withColumnRenamed("key", "own"), ["project", "own"]).withColumn("key", F.col("rep"))
        rows = Cut(rows.select("project", "key", "own", "rank", "at", "seq", "name", "type", "description", "file"), "voted").df
        base = rows.groupBy("project", "key").agg(F.min("at").alias("ord"), F.min_by("name", F.struct("rank", "seq")).alias("name"), F.count(F.lit(1)).alias("mentions"))
        claimed = aliases.select("project", F.col("root").alias("own"), "surface").join(merged.withColumnRenamed("key", "own"), ["project", "own"]).select("project", F.col("rep").alias("key"), "surface")
        absorbed = canon.join(merged, ["project", "key"]).where("rank > 0").select("project", F.col("rep").alias("key"), F.col("name").alias("surface"))
        claimed = claimed.union(absorbed)
    types, descs, sources = (_votes(rows, c, place) for c in ("type", "description", "file"))
    also = claimed.where("surface <> ''").groupBy("project", "key").agg(F.slice(F.array_sort(F.collect_set("surface")), 1, config.NODE_ALIASES).alias("aliases"))
    on = ["project", "key"]
    none = F.array().cast("array<string>")
    nodes = base.join(top_types(types), on, "left").join(modes(descs, "description"), on, "left").join(top_values(sources, "sources", config.NODE_SOURCES), on, "left").join(also, on, "left")
    nodes = nodes.select("project", "key", "ord", strip(F.col("name")).alias("name"), refine_type(F.col("name"), F.coalesce("type", F.lit("Concept"))).alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", none).alias("aliases"), F.coalesce("sources", none).alias("sources"), "mentions")
    # written, as ids need their names first and all of them later
    nodes = Cut(assign_ids(Cut(nodes, "unnumbered").df), "nodes").df
    ids = nodes.select("project", "key", "id")
    if merged is not None:
        ids = merged.join(ids.withColumnRenamed("key", "rep"), ["project", "rep"])
    own = ids.select("project", F.col("key").alias("norm_key"), F.col("id").alias("node_id"))
    through = aliases.join(ids.select("project", F.col("key").alias("root"), "id"), ["project", "root"]).select("project", F.col("alias").alias("norm_key"), F.col("id").alias("node_id"))
    return nodes.drop("key"), Cut(own.union(through).distinct(), "resolution").df
