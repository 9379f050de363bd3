"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often ids end together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.tokens import byte_bpe, byte_table, pieces
from recollect.session import Cut

#: The ids of side B are dealt over this many stripes; a stripe's counts are one dense matrix of side A's ids by its own.
STRIPES = 128
#: Links are counted and dealt out in blocks of about this many.
BLOCK = 1 << 19
#: A stripe with more links than this is scored by several tasks.
CELL = 1 << 26

ENCODED = "row long, doc_id long, n_a int, n_b int, n_groups int, n_links int, groups string, links binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values.astype(np.int64), prepend=0).astype("<u8" if len(values) and values[-1] >> 32 else "<u4").tobytes()) if len(values) else b""


def _expand(data: bytes, wide: bool = False) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<u8" if wide else "<u4").astype(np.int64)) if data else np.zeros(0, np.int64)


class Stripes:
    """Pair codes: side B's ids in stripe order, then side A's id; a stripe's codes are consecutive."""

    def __init__(self, a_size: int, b_size: int, stripes: int = STRIPES):
        self.a, self.stripes = a_size, stripes
        self.rows = -(-b_size // stripes)
        self.width = self.rows * a_size  # cells of a stripe's matrix
        if self.width * stripes >> 32:
            raise ValueError("vocabularies too large for 32-bit pair codes")

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % self.stripes * self.rows + b // self.stripes) * self.a + a

    def split(self, codes: np.ndarray):
        """``(stripe, from, to)`` over ascending codes."""
        ends = np.searchsorted(codes, np.arange(self.stripes + 1) * self.width)
        return [(s, ends[s], ends[s + 1]) for s in range(self.stripes) if ends[s] < ends[s + 1]]


def _grouped(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, text_a: tuple, text_b: tuple) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of the groups that end after the tokens ``cut_a`` and ``cut_b``."""
    out = np.empty(len(a) + len(b), dtype=object)
    ends_a, ends_b = cut_a + 1, cut_b + 1
    group_a = np.searchsorted(ends_a, np.arange(len(a)), side="right")
    group_b = np.searchsorted(ends_b, np.arange(len(b)), side="right")
    at_a = np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]
    at_b = np.arange(len(b)) + ends_a[group_b]
    out[at_a], out[at_b] = text_a[0][a], text_b[0][b]
    out[at_a[cut_a]], out[at_b[cut_b]] = text_a[1][a[cut_a]], text_b[1][b[cut_b]]
    return "".join(out.tolist())[:-1]


def _encode(a_name: str, b_name: str):
    def run(batches):
        left, right = byte_bpe(a_name), pieces(b_name)
        (a_bytes, a_len), (b_bytes, b_len) = byte_table(byte_bpe, a_name), byte_table(pieces, b_name)
        shown = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], dtype=object)
        text_a, text_b = (shown(left.size, ","), shown(left.size, "|")), (shown(right.size, ","), shown(right.size, ";"))
        stripes = Stripes(left.size, right.size)

        def one(text: str | None):
            if not text:
                return 0, 0, 0, 0, "", b""
            whole = " " + text
            data, ids_a, ids_b = whole.encode(), left.ids(whole, special=False), right.ids(text)
            if b"".join([a_bytes[i] for i in ids_a]) != data or b"".join([b_bytes[i] for i in ids_b]) != data:
                return 0, 0, 0, 0, "", b""
            a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
            end_a, end_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
            at = np.searchsorted(end_b, end_a)  # both ascend and end at the same byte, so every place is inside
            cut_a = np.flatnonzero(end_b[at] == end_a)
            cut_b = at[cut_a]
            codes = np.sort(stripes.code(a[cut_a], b[cut_b]))
            return len(a), len(b), len(cut_a), len(cut_a), _grouped(a, b, cut_a, cut_b, text_a, text_b), _squeeze(codes)

        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int32()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("links", pa.binary())])
        make = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            rows, held = [], 0
            for row, doc, text in zip(*(batch.column(n) for n in ("row", "doc_id", "text"))):
                found = one(text.as_py())
                rows.append((row.as_py(), doc.as_py(), *found))
                held += len(found[4]) + 64
                if held > 8 << 20:
                    yield make(rows)
                    rows, held = [], 0
            if rows:
                yield make(rows)

    return run


def encode(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row each with token numbers, ``groups`` and (internal) ``row`` and ``links``.

    Side A encodes space and text, side B the text, to which it adds that space; special tokens' strings are plain text.
    Byte offsets where tokens of both sides end cut them into groups, shown as ``a1,a2|b1;a3|b2,b3``. No token of either
    side is without bytes, so at each such offset exactly one token of each side ends: these are the links.

    Texts that are null, empty or not given back by a side's tokens (a literal U+2581, say) have no tokens: zeros and
    empty groups. Null doc_ids and repeated rows stay as they are; very long texts are encoded whole; other columns are
    ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(a, b), ENCODED)


def _counted(stripes: Stripes, most: int):
    """Distinct pair codes and their counts, a row for each block of links and stripe."""

    def run(batches):
        def flush(held):
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            found = stripes.split(codes)
            return pa.record_batch([pa.array([s for s, _, _ in found], pa.int32()), pa.array([_squeeze(codes[i:j]) for _, i, j in found], pa.binary()), pa.array([n[i:j].astype("<i8").tobytes() for _, i, j in found], pa.binary())], names=["stripe", "codes", "counts"])

        held, size = [], 0
        for batch in batches:
            for links in batch.column("links"):
                held.append(_expand(links.as_py()))
                size += len(held[-1])
                if size >= 8 * most:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _summed(stripes: Stripes):
    """One dense matrix for each stripe, filled from its blocks; its pairs, counts and number of links."""

    def run(batches):
        def done(stripe, block):
            at = np.flatnonzero(block)
            n = block[at]
            return pa.record_batch([pa.array([stripe], pa.int32()), pa.array([_squeeze(at)], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())], names=["stripe", "codes", "counts", "links"])

        now, block = None, np.zeros(stripes.width, dtype=np.int64)
        for batch in batches:
            for stripe, codes, counts in zip(*(batch.column(n) for n in ("stripe", "codes", "counts"))):
                if stripe.as_py() != now:
                    if now is not None:
                        yield done(now, block)
                        block.fill(0)
                    now = stripe.as_py()
                np.add.at(block, _expand(codes.as_py()) - now * stripes.width, np.frombuffer(counts.as_py(), dtype="<i8"))
        if now is not None:
            yield done(now, block)

    return run


def _dealt(stripes: Stripes, parts: dict[int, int], most: int):
    """Links of many documents by stripe: ascending codes, the place of each one's document, and the documents' rows."""

    def run(batches):
        def flush(rows, held):
            codes, doc = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
            order = np.argsort(codes, kind="stable")
            codes, doc, rows = codes[order], doc[order], np.array(rows, dtype=np.int64)
            spread, out = xxhash.xxh32_intdigest(rows.tobytes()), []
            for s, i, j in stripes.split(codes):
                used, place = np.unique(doc[i:j], return_inverse=True)
                out.append((s, spread % parts.get(s, 1), 1, _squeeze(codes[i:j]), place.astype("<u2").tobytes(), rows[used].astype("<i8").tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["stripe", "part", "kind", "codes", "counts", "rows"])

        rows, held, size = [], [], 0
        for batch in batches:
            for row, links in zip(batch.column("row"), batch.column("links")):
                codes = _expand(links.as_py())
                for i in range(0, len(codes), most):  # a document of any length goes in blocks
                    rows.append(row.as_py())
                    held.append(codes[i : i + most])
                    size += len(held[-1])
                    if size >= most or len(rows) == 1 << 16:
                        yield flush(rows, held)
                        rows, held, size = [], [], 0
        if rows:
            yield flush(rows, held)

    return run


def _scored(stripes: Stripes):
    """Scores of links beside their stripe's matrix: sums for each document in a block."""

    def run(batches):
        now, block, best = None, np.zeros(stripes.width, dtype=np.int64), None
        for batch in batches:
            out = []
            for stripe, kind, codes, counts, rows in zip(*(batch.column(n) for n in ("stripe", "kind", "codes", "counts", "rows"))):
                at = _expand(codes.as_py())
                if kind.as_py() == 0:
                    now = stripe.as_py()
                    block.fill(0)
                    block[at] = np.frombuffer(counts.as_py(), dtype="<i8")
                    best = block.reshape(stripes.rows, stripes.a).max(axis=1)
                    continue
                at -= now * stripes.width
                n, doc = block[at], np.frombuffer(counts.as_py(), dtype="<u2")
                row = np.frombuffer(rows.as_py(), dtype="<i8")
                total = np.zeros(len(row), dtype=np.int64)
                np.add.at(total, doc, n)
                out.append((row, np.bincount(doc, weights=n == best[at // stripes.a], minlength=len(row)).astype(np.int64), total))
                if len(out) == 64:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "n_best", "count_sum"])
                    out = []
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "n_best", "count_sum"])

    return run


def score(encoded: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` (with ``row`` and ``links`` of ``encode``; other columns are free) with ``n_best`` and ``count_sum`` for them.

    A pair's count is how many links of the corpus hold it. Links are counted within blocks first, then by stripes of side
    B's ids in dense matrices, so that a pair that a third of all links hold is one row a block. Links are dealt to the
    same stripes, those of a large stripe over several tasks that each hold its matrix; a document's sums over stripes
    are added up by row. ``count_sum`` adds the counts of a document's links; ``n_best`` tells how many have the highest
    count of their B id, ties included. Without links both are 0; an empty table gives an empty result.
    """
    stripes = Stripes(byte_bpe(a).size, pieces(b).size)
    rows = Cut(encoded, "encoded").df
    blocks = rows.where("n_links > 0").select("links").mapInArrow(_counted(stripes, BLOCK), "stripe int, codes binary, counts binary")
    blocks = blocks.repartition(STRIPES, "stripe").sortWithinPartitions("stripe")
    counts = Cut(blocks.mapInArrow(_summed(stripes), "stripe int, codes binary, counts binary, links long"), "pair-counts").df
    # one row a stripe
    parts = {r["stripe"]: -(-r["links"] // CELL) for r in counts.select("stripe", "links").collect()}
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("stripe")), F.lit(1)) if parts else F.lit(1)
    matrix = counts.select("stripe", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)).alias("part"), F.lit(0).alias("kind"), "codes", "counts", F.lit(None).cast("binary").alias("rows"))
    links = rows.where("n_links > 0").select("row", "links").mapInArrow(_dealt(stripes, parts, BLOCK), "stripe int, part int, kind int, codes binary, counts binary, rows binary")
    cells = matrix.unionByName(links).repartition(max(STRIPES, sum(parts.values())), "stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    sums = cells.mapInArrow(_scored(stripes), "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select(*[c for c in rows.columns if c not in ("row", "links")], zero("n_best"), zero("count_sum"))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Documents with their groups and the scores of their links: ``score`` of ``encode``."""
    return score(encode(docs, a, b), a, b)
