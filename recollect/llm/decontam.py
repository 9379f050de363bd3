"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import Cut

#: Length of a q-gram and of a tested segment of an item, the shortest passage of a longer item that must be caught, in normalised characters.
Q, SEGMENT = 10, 80
#: Edits allowed: one in so many characters of the segment.
EDIT_EVERY = 16
#: Width of a diagonal band beyond its overlap with the next.
BAND = 16
#: Segments aligned at a time.
ROWS = 2048
#: Characters of benchmark text in a block, whose index (some 20 bytes a character) is broadcast; blocks that one pass over the documents takes.
BLOCK_CHARS, BLOCKS = 4_000_000, 4
#: Longest piece of an item; longer items are cut into pieces that overlap by all but one character of a segment.
PIECE = 4096
#: Shared q-grams that are counted at a time, and characters of a piece of a document that has more.
HITS, WINDOW = 2_000_000, 2048
#: Words that an item too short for a q-gram must have to be a passage.
SHORT_WORDS = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_junk = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case; whatever is neither letter nor digit becomes one space."""
    return _junk.sub(" ", (text or "").lower()).strip()


def budget(length: int) -> tuple[int, int]:
    """(edits allowed, q-grams that must be shared) for a segment of this length; the lemma's bound is at least 1."""
    edits = length // EDIT_EVERY
    while edits and length + 1 - Q * (edits + 1) < 1:
        edits -= 1
    return edits, length + 1 - Q * (edits + 1)


def segments(length: int) -> list[tuple[int, int]]:
    """Starts and ends of an item's tested segments: one from every place that leaves room for it."""
    w = min(SEGMENT, length)
    return [(s, s + w) for s in range(length - w + 1)] if length >= Q else []


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def qgram_hashes(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of all windows of Q=10 codes, by doubling: 2, 4, 8, then 8+2."""
    if len(c) < Q:
        return np.zeros(0, dtype=np.uint64)
    m = int(_MIX)
    power = lambda n: np.uint64(pow(m, n, 1 << 64))
    c = c.astype(np.uint64)
    two = c[:-1] * _MIX + c[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    return eight[:-2] * power(2) + two[8:]


def banded_distance(a: str, b: str, low: int, high: int, most: int) -> tuple[int, int]:
    """Fewest edits between ``a`` and any substring of ``b`` on paths whose diagonals (place in b minus place in a) lie in low..high.

    Returns (edits, end of the substring); edits above ``most`` are given as most + 1.
    """
    at = b.find(a, max(0, low))
    if 0 <= at <= high:
        return 0, at + len(a)
    y, size, big = codes(b), high - low + 1, most + 1
    diag = np.arange(low, high + 1)
    row = np.where((diag >= 0) & (diag <= len(y)), 0, big).astype(np.int64)
    for i, x in enumerate(codes(a), 1):
        j = i + diag  # place in b after i characters of a, by diagonal
        here = (j >= 1) & (j <= len(y))
        same = np.where(here, y[np.clip(j - 1, 0, max(0, len(y) - 1))] != x, 1) if len(y) else np.ones(size, dtype=np.int64)
        new = np.where(here, row + same, big)
        new = np.minimum(new, np.r_[row[1:], big] + 1)  # a character of a left out
        new = np.where((j >= 0) & (j <= len(y)), new, big)
        steps = np.arange(size)
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, big)  # characters of b left out
        row = np.where((j >= 0) & (j <= len(y)), row, big)
        if row.min() > most:
            return big, -1
    k = int(row.argmin())
    return int(row[k]), len(a) + low + k


def aligned(item: np.ndarray, starts: np.ndarray, w: int, text: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``banded_distance`` of many segments of an item: those of length ``w`` from ``starts``; low..high are places in the text minus places in the item.

    Returns (edits, ends in the text) of each.
    """
    edits, ends = np.full(len(starts), most + 1, dtype=np.int64), np.full(len(starts), -1, dtype=np.int64)
    if not len(text) or not len(starts):
        return edits, ends
    diag, steps, big = np.arange(low, high + 1), np.arange(high - low + 1, dtype=np.int32), np.int32(most + 1)
    live, j = np.arange(len(starts)), starts[:, None] + diag
    row = np.where((j >= 0) & (j <= len(text)), np.int32(0), big)
    for i in range(w):
        j = j + 1
        fits = (j >= 0) & (j <= len(text))
        same = (text[np.clip(j - 1, 0, len(text) - 1)] != item[starts[live] + i][:, None]).astype(np.int32)
        new = np.where(fits & (j >= 1), row + same, big)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a character of the item left out
        new = np.where(fits, new, big)
        new = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, big)  # characters of the text left out
        row = np.where(fits, new, big)
        if i % 8 == 7:
            on = row.min(axis=1) <= most
            if not on.all():
                live, j, row = live[on], j[on], row[on]
                if not len(live):
                    return edits, ends
    best = row.argmin(axis=1)
    edits[live], ends[live] = row[np.arange(len(live)), best], starts[live] + w + diag[best]
    return edits, ends


def pieces(text: str) -> list[tuple[int, str]]:
    """(start, piece) of an item; every segment lies in some piece."""
    if len(text) <= PIECE:
        return [(0, text)]
    return [(s, text[s : s + PIECE]) for s in range(0, len(text) - SEGMENT + 1, PIECE - SEGMENT + 1)]


class Index:
    """The q-grams of a block of benchmark items: hash -> places in the items' pieces laid end to end."""

    def __init__(self, items: list[tuple[int | None, str]]):
        whole = [(i, normalise(t)) for i, t in items]
        cut = [(n, s, x) for n, (_, t) in enumerate(whole) if len(t) >= Q for s, x in pieces(t)]
        #: Items too short for a q-gram, by their text, and the numbers of words that such have.
        self.short: dict[str, list[int]] = {}
        for n, (_, t) in enumerate(whole):
            if len(t) < Q and len(t.split()) >= SHORT_WORDS:
                self.short.setdefault(t, []).append(n)
        self.short_words = sorted({len(t.split()) for t in self.short})
        #: Ids of the items; then item number, start in the item and text of each piece.
        self.ids = [i for i, _ in whole]
        self.owner, self.offset = [n for n, _, _ in cut], [s for _, s, _ in cut]
        self.texts = [x for _, _, x in cut]
        self.starts = np.cumsum([0, *[len(t) for t in self.texts]])
        self.least = np.array([budget(min(SEGMENT, len(t)))[1] for t in self.texts], dtype=np.int64)
        self.slack = np.array([budget(min(SEGMENT, len(t)))[0] for t in self.texts], dtype=np.int64)
        h = [qgram_hashes(codes(t)) for t in self.texts]
        place = [np.arange(len(x)) + s for x, s in zip(h, self.starts)]
        h, place = (np.concatenate(h), np.concatenate(place)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.place = place[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        #: Number of the q-gram and place as one ascending number, by which the places of a range of pieces are found.
        self.ranked = np.repeat(np.arange(len(self.hash)), self.count) * int(self.starts[-1] + 1) + self.place
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self._slot(self.hash)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * _MIX) >> np.uint64(44)

    def found(self, texts: list[str]):
        """All hits of texts already normalised: of q-grams, and of whole short items between word ends."""
        yield from self.hits(texts)
        for n, text in enumerate(texts if self.short else []):
            words = text.split(" ")
            ends = np.cumsum([len(w) + 1 for w in words])
            for k in self.short_words:
                for i in range(len(words) - k + 1):
                    said = " ".join(words[i : i + k])
                    start = int(ends[i]) - len(words[i]) - 1
                    for item in self.short.get(said, ()):
                        yield n, item, start, start + len(said), 0, np.zeros(1, dtype=np.int64)

    def hits(self, texts: list[str]):
        """(text number, item number, span start, span end, edits, starts in the item) of verified segments of texts already normalised.

        At most some HITS shared q-grams are held at a time. Texts that have more are cut into windows that overlap by what a segment
        and its edits span, and windows that have more meet the pieces of the benchmark in ranges.
        """
        if not len(self.hash) or not texts:
            return
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        h = qgram_hashes(codes("\x01".join(texts)))
        maybe = np.nonzero(self.seen[self._slot(h)])[0]
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        real = self.hash[at] == h[maybe]
        where, at = maybe[real], at[real]
        many = self.count[at]
        doc = np.searchsorted(begins, where, side="right") - 1
        per = np.bincount(doc, many, minlength=len(texts)).astype(np.int64)
        if int(per.sum()) <= HITS:
            yield from self._counted(texts, sizes, doc, where - begins[doc], at, 0, len(self.texts))
            return
        if len(texts) > 1:  # texts of more than HITS alone, of the others as many at once as stay near that
            alone = per > HITS
            group = np.where(alone, -1 - np.arange(len(texts)), np.cumsum(np.where(alone, 0, per)) // HITS)
            for g in np.unique(group):
                some = np.nonzero(group == g)[0]
                for n, *found in self.hits([texts[k] for k in some]):
                    yield (int(some[n]), *found)
            return
        text, over = texts[0], SEGMENT + 2 * (SEGMENT // EDIT_EVERY)
        if len(text) > WINDOW + over:
            for s in range(0, len(text), WINDOW):
                for _, i, a, b, edits, found in self.hits([text[s : s + WINDOW + over]]):
                    yield 0, i, a + s, b + s, edits, found
            return
        total = int(self.starts[-1] + 1)
        low = 0
        while low < len(self.texts):  # ranges of pieces, each of at most HITS shared q-grams or a single piece
            high = min(len(self.texts), low + max(1, (len(self.texts) * HITS) // int(per.sum())))
            first = np.searchsorted(self.ranked, at * total + self.starts[low])
            last = np.searchsorted(self.ranked, at * total + self.starts[high])
            while high > low + 1 and int((last - first).sum()) > HITS:
                high = low + (high - low) // 2
                last = np.searchsorted(self.ranked, at * total + self.starts[high])
            some = np.nonzero(last > first)[0]
            yield from self._counted(texts, sizes, doc[some], where[some], at[some], low, high)
            low = high

    def _counted(self, texts, sizes, doc, place, at, low, high):
        """Hits of the q-grams ``at``, which texts ``doc`` have at ``place``, in the pieces from low to high, counted by diagonal band."""
        total = int(self.starts[-1] + 1)
        if low == 0 and high == len(self.texts):
            first, many = self.first[at], self.count[at]
        else:
            first = np.searchsorted(self.ranked, at * total + self.starts[low])
            many = np.searchsorted(self.ranked, at * total + self.starts[high]) - first
        d = np.repeat(place, many)
        doc = np.repeat(doc, many)
        inner = np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)
        item_at = self.place[np.repeat(first, many) + inner]
        item = np.searchsorted(self.starts, item_at, side="right") - 1
        p = item_at - self.starts[item]
        band = (d - p) // BAND
        # the first ``slack`` diagonals of a band belong to the one before as well, so that any path of that many edits lies in one band
        also = np.nonzero((d - p) - band * BAND < self.slack[item])[0]
        doc, item, d, p, band = (np.concatenate([x, x[also] - (1 if x is band else 0)]) for x in (doc, item, d, p, band))
        if not len(doc):
            return
        width = int(sizes.max()) // BAND + 2
        deep = int(max(map(len, self.texts))) // BAND + 2
        key = (doc * len(self.texts) + item) * (width + deep + 2) + band + deep + 1
        order = np.argsort(key, kind="stable")
        edges = np.nonzero(np.diff(key[order], prepend=key[order][:1] - 1))[0]
        counts = np.diff(np.r_[edges, len(order)])
        heads = order[edges]
        for e in np.nonzero(counts >= self.least[item[heads]])[0]:
            rows = order[edges[e] : edges[e] + counts[e]]
            n, i = int(doc[rows[0]]), int(item[rows[0]])
            for start, end, edits, found in self._verified(i, texts[n], int(band[rows[0]]) * BAND, p[rows], d[rows] - p[rows]):
                yield n, self.owner[i], start, end, edits, found + self.offset[i]

    def _verified(self, i, text, low, p, d):
        item, y = codes(self.texts[i]), codes(text)
        w = min(SEGMENT, len(item))
        most, need = budget(w)
        p = np.sort(p)
        # only places that a shared q-gram's segments reach
        starts = np.arange(max(0, int(p[0]) + Q - w), min(len(item) - w, int(p[-1])) + 1)
        starts = starts[np.searchsorted(p, starts + w - Q, side="right") - np.searchsorted(p, starts) >= need]
        for k in range(0, len(starts), ROWS):
            part = starts[k : k + ROWS]
            # verbatim segments lie on a single diagonal
            edits, ends = np.full(len(part), most + 1, dtype=np.int64), np.full(len(part), -1, dtype=np.int64)
            for shift in np.unique(d):
                at = np.arange(part[0], part[-1] + w)
                to = at + shift
                differ = (to < 0) | (to >= len(y))
                differ |= y[np.clip(to, 0, len(y) - 1)] != item[at]
                sums = np.r_[0, np.cumsum(differ)]
                whole = (sums[part - part[0] + w] == sums[part - part[0]]) & (edits > 0)
                edits[whole], ends[whole] = 0, part[whole] + shift + w
            rest = np.nonzero(edits > 0)[0]
            edits[rest], ends[rest] = aligned(item, part[rest], w, y, low - most, low + BAND + 2 * most, most)
            good = edits <= most
            if good.any():
                yield int(ends[good].min()) - w, int(ends[good].max()), int(edits[good].min()), part[good]


def _parts(column):
    """(first row, normalised texts) of a column, some 500,000 characters at a time."""
    at = 0
    while at < len(column):
        part, size, first = [], 0, at
        while at < len(column) and size < 500_000:
            part.append(normalise(column[at].as_py()))
            size += len(part[-1])
            at += 1
        yield first, part


def _scan(shared):
    def run(batches):
        for batch in batches:
            ids, tks, out = batch.column("doc_id"), batch.column("tk"), []
            for first, part in _parts(batch.column("text")):
                for block in shared:
                    best: dict = {}
                    for n, i, s, e, edits, found in block.value.found(part):
                        was = best.get((n, i))
                        best[n, i] = (min(s, was[0]), max(e, was[1]), min(edits, was[2]), np.union1d(was[3], found)) if was else (s, e, edits, found)
                    out += [(ids[first + n].as_py(), tks[first + n].as_py(), block.value.ids[i], max(0, s), e, edits, len(found)) for (n, i), (s, e, edits, found) in sorted(best.items())]
            yield pa.RecordBatch.from_pylist([dict(zip(_HITS.names, r)) for r in out], schema=_HITS)

    return run


def _clean(shared, at: int):
    """Batches without the rows whose text (column ``at``) shares a passage with a block."""

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for first, part in _parts(batch.column(at)):
                for block in shared:
                    for n, *_ in block.value.found(part):
                        keep[first + n] = False
            yield batch.filter(pa.array(keep))

    return run


_HITS = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("item_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("edits", pa.int32()), ("matches", pa.int32())])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, tk, item_id, span_start, span_end, edits, matches)`` for each document and item that share a passage.

    The shortest passage that must be caught is SEGMENT characters of an item, wherever
    they start (the whole item, if shorter); each such segment is tested. A document shares one if some substring of it, normalised, is
    within one edit per EDIT_EVERY characters. By the q-gram lemma such a
    substring shares at least ``w + 1 - Q (e + 1)`` q-grams with the segment,
    all within e diagonals; so shared q-grams are counted in overlapping
    diagonal bands, bands that reach the bound are kept, and banded alignment
    verifies the segments that reach it. No match is lost to the filter. Spans are places in
    the normalised text, edits the fewest of any segment, matches the number of verified segments.

    The benchmark is taken in blocks of BLOCK_CHARS characters, BLOCKS of which are
    broadcast and met by one pass over the documents, so its size is not limited;
    documents never shuffle. Items shorter than Q normalised characters hold no q-gram: they are looked up whole, from word end to word end,
    if they have SHORT_WORDS words; a word or two are no passage. Null or empty texts share nothing; rows of null item_id are items of their own, by text; null doc_ids are kept as null; repeated rows of documents repeat
    in the result; texts of any length are read whole; other columns are ignored; empty tables give an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    found = []
    for blocks, last in _shared(benchmark):
        part = rows.mapInArrow(_scan(blocks), "doc_id long, tk long, item_id long, span_start long, span_end long, edits int, matches int")
        found.append(part if last else Cut(part, "hits").df)
        if not last:
            _release(blocks)
    return reduce(DataFrame.union, found)


def _release(blocks: list) -> None:
    for block in blocks:
        block.unpersist()


def _shared(benchmark: DataFrame):
    """Broadcast indexes of the benchmark, BLOCKS at a time, and whether they are the last."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    for low in range(0, blocks, BLOCKS):
        parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() for b in range(low, min(blocks, low + BLOCKS))]
        yield [spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part])) for part in parts], low + BLOCKS >= blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, columns unchanged (see ``contaminated``).

    The scan itself lets rows pass, so nothing is shuffled; between the passes of a large benchmark the rows left are written.
    """
    at = docs.columns.index("text")
    for blocks, last in _shared(benchmark):
        docs = docs.mapInArrow(_clean(blocks, at), docs.schema)
        if not last:
            docs = Cut(docs, "clean").df
            _release(blocks)
    return docs
