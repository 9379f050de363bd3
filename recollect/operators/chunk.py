"""Chunking Markdown: heading blocks, oversize split, greedy packing with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import config
from recollect.functions.text import WS, bound, computed, strip, words


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", " ")


def heading_blocks(text: Column) -> Column:
    """Blocks that begin at headings; comments are taken out first."""
    return F.split(without_comments(text), r"\n(?=#{1,6}[^\S\n])", -1)


def sized_blocks(blocks: Column, size: int) -> Column:
    """Blocks of more than ``size`` words as pieces of ``size`` words."""

    def cut(b: Column) -> Column:
        w = words(b)
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
        return F.when(F.size(w) <= size, F.array(b)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")))

    return F.flatten(F.transform(blocks, cut))


def cuts(sizes: Column, size: int, overlap: int) -> Column:
    """Where chunks begin and end, from the numbers of words of their pieces.

    A chunk takes pieces until the next would exceed ``size`` words, and begins with the last ``overlap`` words of the one before,
    which are simply the words before its first piece. Each is ``first`` and ``count`` of its pieces, ``at``, the number of words
    before them, ``lead``, how many of these it repeats, and ``n``, its number of words.
    """
    start = F.struct(F.array().cast("array<struct<first:int,count:int,at:int,lead:int,n:int>>").alias("out"), *[F.lit(0).alias(c) for c in ("first", "count", "at", "lead", "n", "i", "pos")])

    def step(s: Column, w: Column) -> Column:
        closed = F.concat(s["out"], F.array(F.struct(*[s[c].alias(c) for c in ("first", "count", "at", "lead", "n")])))
        full = (s["n"] + w > size) & (s["count"] > 0)
        fresh = full | (s["count"] == 0)
        lead = F.when(full, F.least(F.lit(overlap), s["n"])).when(s["count"] == 0, F.lit(0)).otherwise(s["lead"])
        first, at = F.when(fresh, s["i"]).otherwise(s["first"]), F.when(fresh, s["pos"]).otherwise(s["at"])
        before = F.when(fresh, lead).otherwise(s["n"])
        count, n = F.when(fresh, F.lit(1)).otherwise(s["count"] + 1), before + w
        out = F.when(full, closed).otherwise(s["out"])
        now = F.struct(first.alias("first"), count.alias("count"), at.alias("at"), lead.alias("lead"), n.alias("n"))
        # a lead longer than a chunk can bring it to twice the size: it ends at once, and the next repeats nothing
        huge = n > 2 * size
        return F.struct(
            F.when(huge, F.concat(out, F.array(now))).otherwise(out).alias("out"), first.alias("first"), F.when(huge, F.lit(0)).otherwise(count).alias("count"), at.alias("at"), lead.alias("lead"),
            F.when(huge, F.lit(0)).otherwise(n).alias("n"), (s["i"] + 1).alias("i"), (s["pos"] + w).alias("pos"),
        )

    last = lambda s: F.when(s["count"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(*[s[c].alias(c) for c in ("first", "count", "at", "lead", "n")]))))
    return F.aggregate(sizes, start, step, last)


def chunks_of(text: Column, size: int = config.CHUNK_WORDS, overlap: int = config.CHUNK_OVERLAP) -> Column:
    """The chunks of a text, without those of fewer than three words: places first, by numbers of words, then texts."""

    def texts(pieces: Column, by_piece: Column) -> Column:
        found = F.filter(cuts(F.transform(by_piece, F.size), size, overlap), lambda c: c["n"] >= 3)
        body = lambda c: F.array_join(F.slice(pieces, c["first"] + 1, c["count"]), "\n")
        lead = lambda every, c: F.concat(F.array_join(F.slice(every, c["at"] - c["lead"] + 1, c["lead"]), " "), F.lit("\n"))
        return bound(F.flatten(by_piece), lambda every: F.transform(found, lambda c: strip(F.when(c["lead"] > 0, F.concat(lead(every, c), body(c))).otherwise(body(c)))))

    return bound(sized_blocks(heading_blocks(text), size), lambda p: bound(F.transform(p, words), lambda w: texts(p, w)))


def plain_chunks_of(text: str, word_list: str, size: int, overlap: int) -> Column:
    """``chunks_of`` for texts without headings and comments, in closed form: pieces of ``size`` words, each led by the overlap.

    ``text`` and ``word_list``, its words, name columns, so that the words are split once.
    """
    n = F.size(word_list)
    lead = lambda i: F.least(F.lit(overlap), i - 1)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)), lambda i: F.least(F.lit(size), n - i + 1) + lead(i) >= 3)
    join = lambda i, k: F.array_join(F.slice(word_list, i, k), " ")
    many = F.transform(starts, lambda i: F.when(lead(i) > 0, F.concat(join(i - lead(i), lead(i)), F.lit("\n"), join(i, F.lit(size)))).otherwise(join(i, F.lit(size))))
    # most texts have no space at their ends: two characters tell
    body = F.col(text)
    ends = F.concat(F.left(body, F.lit(1)), F.right(body, F.lit(1)))
    whole = F.when(ends.rlike(WS), strip(body)).otherwise(body)
    return F.when(n < 3, F.array().cast("array<string>")).when(n <= size, F.array(whole)).otherwise(many)


def chunk_documents(docs: DataFrame, size: int | None = None, overlap: int | None = None, most: int | None = config.MAX_CHUNKS, text: str = "body") -> DataFrame:
    """One row per chunk: the columns of ``docs`` but the text, then ``chunk`` (from 0) and ``text``.

    ``most`` keeps the first chunks of each document; None keeps all. A null text has none. Texts
    without headings take the closed form, which needs no fold.
    """
    size = config.CHUNK_WORDS if size is None else size
    overlap = config.CHUNK_OVERLAP if overlap is None else overlap
    rest = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    headed = F.lit(overlap > size) | body.rlike(r"\n#{1,6}[^\S\n]")
    rows = docs.select(*rest, body.alias("_body"), headed.alias("_headed"))
    rows = computed(rows, _plain=F.when(~F.col("_headed"), without_comments(F.col("_body"))))
    rows = computed(rows, _words=words(F.col("_plain")))
    made = F.when(F.col("_headed"), chunks_of(F.col("_body"), size, overlap)).otherwise(plain_chunks_of("_plain", "_words", size, overlap))
    if most is not None:
        made = F.slice(made, 1, most)
    return rows.select(*rest, F.posexplode(made).alias("chunk", "text"))
