"""Fuzzy line dedup: MinHash candidates, exact Jaccard, distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.components import connected_components
from recollect.session import Cut, release

#: Characters in a shingle, Jaccard similarity of a link, and characters below which a line is linked to equal ones only.
SHINGLE, THRESHOLD, MIN_CHARS = 6, 0.8, 20
#: Two lines of similarity 0.8 share a band with probability 0.98, of 0.85 with 0.997.
BANDS, ROWS = 10, 5
#: Lines of a block of the second look, and blocks beyond which cells by rare shingles are tried for a bucket; both ways find the same.
BLOCK, DEEP = 1024, 64
#: Slots in which shingles are counted to order them by rarity (a power of two).
SLOTS = 1 << 20
#: Code points below which shingles are packed into 64 bits, and shingles counted at a time.
BASE, COLUMNS = 1600, 4096
#: Rows of one key that a task takes at most; at most HOT keys have more than both this and a HOT-th of all rows, and are dealt over several tasks.
SPREAD, HOT = 512, 10_000
#: Bits of the filter that picks lines for verification (a power of two; broadcast at 16 MB).
FILTER = 1 << 24
_rng = np.random.Generator(np.random.PCG64(20))
#: Factors and summands of the hashes.
_A = (_rng.integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32) | np.uint32(1))[0]
_C = _rng.integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)[0]
_M, _R = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of lines of SHINGLE characters at least: bands of MinHash values over character shingles."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    c = _codes(lines)
    h = c[: len(c) - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        h *= _R
        h += c[j : len(c) - SHINGLE + 1 + j]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    own = np.ones(len(c), dtype=bool)  # shingles that cross into the next line don't count
    ends = np.cumsum(size)
    for j in range(1, SHINGLE):
        own[ends - j] = False
    h = h[own[: len(h)]]
    starts = np.cumsum(size - SHINGLE + 1) - (size - SHINGLE + 1)
    least = np.empty((len(lines), BANDS * ROWS), dtype=np.uint64)
    t = np.empty_like(h)
    for i in range(BANDS * ROWS):
        np.multiply(h, _A[i], out=t)
        t += _C[i]
        least[:, i] = np.minimum.reduceat(t, starts)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(lines), 1))
    for r in range(ROWS):
        keys = (keys + least[:, r::ROWS]) * _M
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """Place and normal form (lower case, white space as one space) of each line that isn't blank."""
    if not text:
        return []
    # printable text has no white space but blanks, and most lines have single ones only
    found = ((i, x.strip(" ") if x.isprintable() and "  " not in x else " ".join(x.split())) for i, x in enumerate(text.lower().split("\n")))
    return [(i, x) for i, x in found if x]


def line_hash(line: str) -> int:
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _read(batches):
    """Every line's place and hash; the band keys go with a long enough line's first sight only, as far as the task remembers."""
    seen: set[int] = set()  # bounded; only saves work
    for batch in batches:
        ids, tks, texts = batch.column("doc_id"), batch.column("tk"), batch.column("text")
        at = 0
        while at < len(texts):
            doc, pos, lh, fresh, lines, chars = [], [], [], [], [], 0
            while at < len(texts) and chars < 60_000:
                for i, x in normal_lines(texts[at].as_py()):
                    h = line_hash(x)
                    doc.append(at)
                    pos.append(i)
                    lh.append(h)
                    if len(x) >= MIN_CHARS and h not in seen:
                        if len(seen) < 300_000:
                            seen.add(h)
                        fresh.append(len(lh) - 1)
                        lines.append(x)
                        chars += len(x)
                at += 1
            if not doc:
                continue
            size = np.zeros(len(lh), dtype=np.int32)
            size[fresh] = BANDS
            keys = pa.array(band_keys(lines).ravel() if lines else np.zeros(0, np.int64))
            take = pa.array(doc, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), tks.take(take), pa.array(pos, pa.int32()), pa.array(lh, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), keys)],
                names=["doc_id", "tk", "pos", "lh", "keys"],
            )


def _texts(wanted):
    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            lh, out = [], []
            for t in batch.column("text").to_pylist():
                for _, x in normal_lines(t):
                    h = line_hash(x)
                    if bits[h & (FILTER - 1)] and h not in seen:
                        if len(seen) < 300_000:
                            seen.add(h)
                        lh.append(h)
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(lh, pa.int64()), pa.array(out, pa.string())], names=["lh", "line"])

    return run


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def packed(line: str) -> np.ndarray | None:
    """The shingles of a line as sorted numbers, one to one; None where characters beyond BASE leave no room for that."""
    c = _codes([line])
    if c.max(initial=0) >= BASE:
        return None
    n = len(c) - SHINGLE + 1
    c = c.astype(np.uint64)
    h = c[:n].copy()
    for j in range(1, SHINGLE):
        h *= np.uint64(BASE)
        h += c[j : j + n]
    h.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def _verified(batches):
    last, x, spelled = None, None, None
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist()):
            if a != last:
                last, x, spelled = a, packed(a), None
            y = packed(b) if x is not None else None
            if y is None:  # characters that numbers have no room for
                spelled = shingles(a) if spelled is None else spelled
                z = shingles(b)
                n, m, both = len(spelled), len(z), len(spelled & z)
            else:
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                n, m, both = len(x), len(y), int(np.count_nonzero(x[at] == y))
            keep.append(both >= THRESHOLD * (n + m - both))
        yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))


def block_links(rest: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Pairs of (id, component, line) from ``rest`` and ``others`` of different components that reach THRESHOLD.

    What two lines share is counted by products of the lines' incidence with shingles, some COLUMNS shingles at a time;
    shingles of a single line are left out.
    """
    lines = [x for _, _, x in rest] + [x for _, _, x in others]
    sets = [packed(x) for x in lines]
    if any(x is None for x in sets):
        number: dict[str, int] = {}
        sets = [np.array([number.setdefault(g, len(number)) for g in shingles(x)], dtype=np.uint64) for x in lines]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    where = np.repeat(np.arange(len(lines)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    place = np.cumsum(several) - 1
    on = several[column]
    where, column = where[on], place[column[on]]
    n, shared = len(rest), np.zeros((len(rest), len(others)))
    total = int(several.sum())
    for low in range(0, total, COLUMNS):
        now = (column >= low) & (column < low + COLUMNS) if total > COLUMNS else slice(None)
        m = np.zeros((len(lines), min(COLUMNS, total - low)), dtype=np.float32)
        m[where[now], column[now] - low] = 1.0
        shared += m[:n] @ m[n:].T
    left, right = size[:n, None], size[None, n:]
    comps = np.array([c for _, c, _ in others], dtype=np.int64)
    near = (shared >= THRESHOLD * (left + right - shared)) & (np.array([c for _, c, _ in rest], dtype=np.int64)[:, None] != comps[None, :])
    return [(min(rest[i][0], others[j][0]), max(rest[i][0], others[j][0])) for i, j in zip(*(x.tolist() for x in np.nonzero(near)))]


def _second(batches):
    """Links of each block (rep, cell, i, j): rows of side 0 against those of side 1."""

    def done(group):
        rest, others = [r[1:] for r in group if r[0] == 0], [r[1:] for r in group if r[0] == 1]
        return block_links(rest, others) if rest and others else []

    current, group, out = None, [], []
    for batch in batches:
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in ("rep", "cell", "i", "j"))), zip(*(batch.column(c).to_pylist() for c in ("side", "lh", "c", "line")))):
            if key != current:
                out += done(group) if group else []
                current, group = key, []
            group.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])
        out = []
    out = done(group) if group else []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])


def shingle_keys(line: str) -> np.ndarray:
    """A 64-bit key for each of a line's distinct shingles."""
    return np.array([xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass")) for g in shingles(line)], dtype=np.uint64)


def _met(batches):
    """``(slot, n)``: how many shingles of a batch's lines fall in each of SLOTS slots."""
    for batch in batches:
        keys = [shingle_keys(x) for x in batch.column("line").to_pylist()]
        slot, n = np.unique(np.concatenate(keys) & np.uint64(SLOTS - 1) if keys else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])


def prefix(line: str, counts: np.ndarray) -> np.ndarray:
    """The keys of a line's rarest shingles: two lines of similarity THRESHOLD share one of them, whatever ``counts`` says.

    Such lines share at least that part of either's shingles. So, with all shingles in one order, each has the first shared one
    among those left when the others are fewer than it must share. Shingles of one key stand for each other in the order.
    """
    keys = shingle_keys(line)
    least = int(np.ceil(THRESHOLD * len(keys) - 1e-9))
    order = np.lexsort((keys, counts[keys & np.uint64(SLOTS - 1)]))
    return np.unique(keys[order[: len(keys) - least + 1]]).view(np.int64)


def _cells(counts):
    """A row for each cell of a line: the keys of its ``prefix``."""

    def run(batches):
        for batch in batches:
            keys = [prefix(x, counts.value) for x in batch.column("line").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int32())
            cells = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rep", "lh", "c", "main")), cells], names=["rep", "lh", "c", "main", "cell"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")


def _slots(hashes: DataFrame, name: str) -> np.ndarray:
    """Which of FILTER slots the hashes fall in: a filter of fixed size, whatever the number of hashes."""
    slot = F.col(name).bitwiseAND(F.lit(FILTER - 1))
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((`{name}` & {FILTER - 1}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER // 64, dtype="<i8")
    bits[np.asarray(got["w"])] = np.asarray(got["b"])
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def _shared_keys(wanted):
    """Rows (key, lh) of the keys whose slot is marked."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            column = batch.column("keys")
            keys = np.asarray(column.flatten(), dtype=np.int64)
            lines = np.repeat(np.asarray(batch.column("lh"), dtype=np.int64), np.diff(np.asarray(column.offsets)))
            on = bits[keys & (FILTER - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(lines[on])], names=["key", "lh"])

    return run


def _line_texts(need: DataFrame, docs: DataFrame) -> Cut:
    """``(lh, line)`` of the wanted hashes.

    The lines are read from the documents again. A filter of FILTER bits spares the
    shuffle most lines that nobody wants; what it lets through, a join decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_slots(need, "lh"))
    lines = _rows(docs).select("text").mapInArrow(_texts(shared), "lh long, line string")
    return Cut(lines.join(need.hint("shuffle_hash"), "lh", "left_semi").groupBy("lh").agg(F.min("line").alias("line")), "line-text")


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _parts)`` of the keys that hold so many rows that they are dealt over several tasks: HOT at most, whatever the table."""
    total = rows.count()
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(SPREAD, total // HOT))
    return sizes.select(key, F.ceil(F.col("_n") / SPREAD).cast("int").alias("_parts"))


def _spread(rows: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``rows`` with ``part``: which of a hot key's parts a row is in, by hash; 0 for other keys."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def _copied(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows``, one per key, once for each ``part``."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def _buckets(lines: DataFrame) -> Cut:
    """``(key, lh, seen)`` of the band keys that several lines share; ``seen`` is how many tasks met the line.

    Most keys belong to one line. An aggregate with map-side partials finds the others, so that a key that
    many lines share is no burden to a task; a filter of FILTER bits then spares the shuffle most rows of unshared keys.
    """
    keyed = lines.where("size(keys) > 0").select("lh", "keys")
    ends = keyed.select("lh", F.explode("keys").alias("key")).groupBy("key").agg(F.min("lh").alias("least"), F.max("lh").alias("most"))
    several = Cut(ends.where("least < most").select("key"), "line-keys")
    wanted = lines.sparkSession.sparkContext.broadcast(_slots(several.df, "key"))
    met = keyed.mapInArrow(_shared_keys(wanted), "key long, lh long").groupBy("key", "lh").agg(F.count(F.lit(1)).alias("seen"))
    held = Cut(met.join(several.df, "key", "left_semi"), "line-buckets")
    several.drop()
    return held


def _blocks(members: DataFrame, main: DataFrame, text: DataFrame, hot: DataFrame) -> DataFrame:
    """The members ``(rep, lh, c)`` of unsettled buckets ``(rep, main)`` in blocks ``(rep, cell, i, j)``, with their lines, sorted by block.

    A block has lines of side 0, outside the main component, and of side 1, all lines. Buckets of
    more than DEEP blocks are dealt into cells of lines that share a rare shingle (see ``prefix``), which loses no link, or
    taken whole where cells would have more pairs than the bucket.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    every = _spread(members, "rep", "lh", hot).join(_copied(main, "rep", hot), ["rep", "part"]).drop("part")
    whole = ["rep", "lh", "c", "main", F.lit(0).cast("long").alias("cell"), "ni", "nj"]
    rows = every.where(F.col("all") <= DEEP * BLOCK).select(*whole)
    large = main.where(F.col("all") > DEEP * BLOCK)
    if not large.isEmpty():
        deep = Cut(every.where(F.col("all") > DEEP * BLOCK).join(text, "lh").select("rep", "lh", "c", "main", "ni", "nj", "line"), "line-deep").df
        met = deep.mapInArrow(_met, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(SLOTS, dtype=np.int64)
        counts[np.asarray(met["slot"])] = np.asarray(met["n"])
        shared = text.sparkSession.sparkContext.broadcast(counts)
        celled = Cut(deep.select("rep", "lh", "c", "main", "line").mapInArrow(_cells(shared), "rep long, lh long, c long, main long, cell long"), "line-cells").df
        sizes = celled.groupBy("rep", "cell").agg(F.count(F.lit(1)).alias("nj"), F.count_if(F.col("c") != F.col("main")).alias("ni")).where("ni > 0 and nj > 1")
        sizes = Cut(sizes, "line-cell-sizes").df
        # pairs of lines, not of blocks: most cells are smaller than a block
        dear = sizes.groupBy("rep").agg(F.sum(F.col("ni").cast("double") * F.col("nj")).alias("pairs")).join(large.select("rep", "others", "all"), "rep").where(F.col("pairs") > F.col("others").cast("double") * F.col("all")).select("rep")
        dear = Cut(dear, "line-dear").df
        sizes = sizes.join(F.broadcast(dear), "rep", "left_anti").select("rep", "cell", blocks(F.col("ni")).alias("ni"), blocks(F.col("nj")).alias("nj"))
        rows = rows.unionByName(celled.join(sizes, ["rep", "cell"])).unionByName(deep.join(F.broadcast(dear), "rep", "left_semi").select(*whole))
    rows = rows.withColumn("h", F.xxhash64("lh"))
    other = rows.select("rep", "cell", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod("h", "nj").cast("int").alias("j"), F.lit(1).alias("side"), "lh", "c")
    rest = rows.where("c <> main").select("rep", "cell", F.pmod("h", "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "lh", "c")
    dealt = rest.unionByName(other).join(text.hint("merge"), "lh")
    return dealt.repartition("rep", "cell", "i", "j").sortWithinPartitions("rep", "cell", "i", "j")


def line_components(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``(lh, component)`` for lines linked to others: components of all verified candidate pairs.

    Candidates are lines that share a band key. In each bucket all members are
    verified against the one that most tasks saw. Then the members of all buckets of such a line are taken
    together: those outside their largest component so far meet the others in pairs of blocks of at most some 2 BLOCK lines
    (see ``block_links``). That leaves no candidate pair
    undecided but those already connected, and no bucket is expanded into its pairs. Buckets of more than DEEP
    blocks are compared by cells that lose no link (see ``_blocks``), so what is linked does not depend on their size.
    """
    held = _buckets(lines)
    # a line that many tasks saw is the likeliest to be what others vary, and so the best to verify them against
    drawn = held.df.groupBy("key").agg(F.max(F.struct("seen", F.xxhash64("lh").alias("r"), "lh")).alias("m")).select("key", F.col("m.lh").alias("rep"))
    stars = Cut(held.df.join(drawn, "key").where("lh <> rep").select(F.col("rep").alias("src"), F.col("lh").alias("dst")).distinct(), "line-pairs")
    held.drop()
    release(lines.sparkSession)
    text = _line_texts(stars.df.select(F.col("src").alias("lh")).union(stars.df.select("dst")).distinct(), docs)
    hot = Cut(_hot(stars.df, "src"), "line-hot")
    a = _copied(text.df.toDF("src", "a_line"), "src", hot.df)
    b = text.df.toDF("dst", "b_line")
    pairs = _spread(stars.df, "src", "dst", hot.df).join(b.hint("merge"), "dst").join(a.hint("merge"), ["src", "part"])
    links = Cut(pairs.mapInArrow(_verified, "src long, dst long"), "line-links")
    comp = Cut(connected_components(links.df).select(F.col("node").alias("lh"), "component"), "line-components")
    release(lines.sparkSession)
    members = stars.df.select(F.col("src").alias("rep"), F.col("dst").alias("lh")).union(stars.df.select("src", "src").distinct())
    placed = Cut(members.join(comp.df, "lh", "left").select("rep", "lh", F.coalesce("component", "lh").alias("c")), "placed")
    per = placed.df.groupBy("rep", "c").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("rep").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    others = F.col("all") - F.col("m.n")
    main = main.where("parts > 1 and all > 2").select("rep", F.col("m.c").alias("main"), "all", others.alias("others"), blocks(others).alias("ni"), blocks(F.col("all")).alias("nj"))
    main = Cut(main, "line-mains")
    dealt = _blocks(placed.df, main.df, text.df, hot.df.withColumnRenamed("src", "rep"))
    found = Cut(dealt.mapInArrow(_second, "src long, dst long").distinct(), "line-links").df
    for old in (stars, text, placed, main, hot):
        old.drop()
    if found.isEmpty():
        return comp.df
    # what the second look found joins the components of the first
    one, two = comp.df.toDF("src", "s"), comp.df.toDF("dst", "d")
    bridges = found.join(one, "src", "left").join(two, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"))
    merged = connected_components(bridges).toDF("component", "merged")
    old = comp.df.join(merged, "component", "left").select("lh", F.coalesce("merged", "component").alias("component"))
    new = merged.join(comp.df.select(F.col("component")).distinct(), "component", "left_anti").toDF("lh", "component")
    return old.union(new.join(comp.df.select("lh"), "lh", "left_anti"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one line kept of each group of equal or similar lines.

    A line counts by its lower case with runs of white space as one space;
    blank lines are never touched. Lines are linked when equal, or, from MIN_CHARS such characters on,
    when their shingle sets have Jaccard similarity THRESHOLD or more (found by MinHash banding, verified
    exactly); of each component the line with the smallest
    (doc_id, text hash, place) stays and the others leave their documents.

    Result: the columns of ``docs`` with ``text`` rewritten, then ``n_lines`` and
    ``n_removed`` (incoming columns of those names are replaced). Documents from which every
    line left remain, with empty text. Null text has no lines and stays null; a very long line counts whole.
    Rows without doc_id come last in the order that chooses the kept line; rows that repeat
    doc_id and text are one document, and get the same text. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*own)
    read = Cut(_rows(docs).mapInArrow(_read, "doc_id long, tk long, pos int, lh long, keys array<long>"), "lines")
    lines = read.df
    comp = line_components(lines, docs)
    release(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "pos")
    groups = lines.select("lh", place.alias("place")).groupBy("lh").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    groups = groups.join(comp, "lh", "left").where("n > 1 or component is not null")
    groups = Cut(groups.select("lh", "place", F.coalesce("component", "lh").alias("component")), "line-groups")
    best = groups.df.groupBy("component").agg(F.min("place").alias("best"))
    hot = Cut(_hot(groups.df, "component"), "line-hot")
    kept = _spread(groups.df, "component", "lh", hot.df).join(_copied(best, "component", hot.df), ["component", "part"]).select("lh", "best")
    gone = lines.select("lh", place.alias("place")).join(kept, "lh").where("place <> best")
    gone = gone.select("place.doc_id", "place.tk", "place.pos").groupBy(F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).agg(F.collect_set("pos").alias("_gone"))
    gone = Cut(gone, "lines-gone")
    read.drop()
    release(docs.sparkSession)
    keyed = docs.withColumn("_tk", F.xxhash64("text"))
    joined = keyed.join(gone.df.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_tk") == F.col("_t")), "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else c for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
    )
