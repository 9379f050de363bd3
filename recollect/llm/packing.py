"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.tokens import byte_bpe
from recollect.session import Cut

#: Pieces of one length are numbered in this many shares, so that a length that a third of all rows have is no single group.
SHARES = 64
#: Arrow batches of about this many bytes leave a task.
FLUSH = 8 << 20


class OpenBins:
    """Groups of equal bins by remaining room, under a segment tree: the tightest that holds a length in logarithmic time.

    A group is ``(first, bins)``, the numbers of consecutive bins. A node of the tree tells whether any leaf below it has
    a group; leaf r stands for room r.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, first: int, bins: int) -> None:
        self.groups[room].append((first, bins))
        i = room + self.leaves
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Remove and return ``(room, first, bins)`` of a group with the least room of ``length`` or more."""
        i = length + self.leaves
        while not self.tree[i]:
            while i & 1:  # from a right child up
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        first, bins = self.groups[room].pop()
        if not self.groups[room]:
            self.tree[i] = 0
            while i > 1 and not self.tree[i ^ 1]:
                i >>= 1
                self.tree[i] = 0
        return room, first, bins


def best_fit(counts: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts[length]`` pieces of each length below ``capacity``; ``(runs, number of bins)``.

    Pieces of one length are alike, and so are bins of one room, so a run of pieces takes one search in the tree: each
    bin of the tightest group takes as many as fit, as it would one by one, since it stays the tightest until it is too
    small. A run is a row ``(length, rank of its first piece among its length, first bin, pieces a bin, tokens before)``;
    every length splits at most one group, so there are at most a few groups and runs a length, whatever the counts.
    """
    free, bins_made, runs = OpenBins(capacity), 0, []
    for length in range(capacity - 1, 0, -1):
        left, done = counts[length], 0
        while left:
            found = free.take(length)
            if found is None:
                new = -(-left // (capacity // length))
                found, bins_made = (capacity, bins_made, new), bins_made + new
            room, first, bins = found
            each = room // length
            full = min(bins, left // each)
            runs.append((length, done, first, each, capacity - room))
            if full:
                free.put(room - each * length, first, full)
                done, left = done + full * each, left - full * each
            if full < bins and left:  # fewer than fill one bin
                free.put(room - left * length, first + full, 1)
                done, left, full = done + left, 0, full + 1
            if full < bins:
                free.put(room, first + full, bins - full)
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins_made


def _cut(capacity: int, end: int, vocab: str):
    names = ["row", "doc_id", "piece", "start", "length", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        bpe = byte_bpe(vocab)
        rows, held = [], 0
        make = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(n) for n in ("row", "doc_id", "text"))):
                ids = np.array([*bpe.ids(text.as_py() or ""), end], dtype="<u4")
                start, piece = 0, 0
                while start < len(ids):
                    stop = start + (len(ids) - start - 1) % capacity + 1  # the first piece takes what is over
                    rows.append((row.as_py(), doc.as_py(), piece, start, stop - start, ids[start:stop].tobytes()))
                    start, piece = stop, piece + 1
                held += 4 * len(ids) + 64
                if held > FLUSH:
                    yield make(rows)
                    rows, held = [], 0
        if rows:
            yield make(rows)

    return run


def _place(runs: np.ndarray, base: np.ndarray):
    """Sequence and offset of each piece from its share and place: its rank among its length, then the run that holds it."""
    starts = (runs[:, 0] << 48) | runs[:, 1]
    order = np.argsort(starts)
    starts, runs = starts[order], runs[order]

    def run(batches):
        for batch in batches:
            col = lambda n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            length = col("length")
            rank = base[length, col("share")] + col("place") - 1
            found = runs[np.searchsorted(starts, (length << 48) | rank, side="right") - 1]
            past = rank - found[:, 1]
            sequence, offset = found[:, 2] + past // found[:, 3], found[:, 4] + past % found[:, 3] * length
            keep = [n for n in batch.schema.names if n not in ("share", "place")]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 1024, vocab: str = "byte_bpe_50k.json", end: int = 2) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``: every piece of every document and its place.

    A document's ids are its text's, then ``end``. Documents of more than ``capacity`` ids are cut into pieces of
    ``capacity``, of which the first may be shorter; ``ids`` are the piece's as little-endian unsigned 32-bit numbers.
    Pieces of a full sequence need no search. The others are counted by length, and best-fit decreasing runs over the
    counts, which are fewer than ``capacity`` however many documents there are; each piece then finds its place from its
    rank among its length. The packing is that of the whole table, not of its partitions. Ids are written once and move
    once, those of full pieces not at all.

    Null text is empty text: one piece, the end. Null doc_ids stay null; repeated rows are packed each; texts of any
    length are tokenised whole; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_cut(capacity, end, vocab), "row long, doc_id long, piece int, start long, length long, ids binary")
    pieces = Cut(made.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int")), "pieces").df
    part = pieces.where(F.col("length") < capacity)
    # at most capacity x SHARES rows
    sizes = part.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")).collect()
    count = np.zeros((capacity, SHARES), dtype=np.int64)
    for r in sizes:
        count[r["length"], r["share"]] = r["n"]
    runs, bins = best_fit(count.sum(axis=1).tolist(), capacity)
    base = np.cumsum(count, axis=1) - count
    # a document has one piece below capacity at most, so row orders a share's pieces of a length
    placed = part.withColumn("place", F.row_number().over(Window.partitionBy("length", "share").orderBy("row")))
    cols = ["doc_id", "piece", "start", "length", "ids"]
    placed = placed.select(*cols, "share", "place").mapInArrow(_place(runs, base), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(*cols, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, doc_ids, ids)``: the packed pieces joined to sequences, documents in order of place."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), joined.alias("ids"))
