"""Chat formatting by quotation linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.components import connected_components
from recollect.session import Cut

#: A quoted line: marks ``>`` with optional space, at the start.
MARKS = r"^(?:[ \t]{0,3}>)+"
#: A line that opens or closes a stretch of code.
FENCE = r"^[ \t]{0,3}(?:```|~~~)"
#: A text with a quoted line.
QUOTES = r"(?:^|\n)(?:[ \t]{0,3}>)"
#: A line that, right before a quote, only introduces it.
LEAD_IN = r"(?i)^\s*(?:on .{1,200}\bwrote|.{1,80}\b(?:wrote|writes|said|schrieb|a écrit|escribió))\s*:\s*$"
#: Words that a passage must have to link to another conversation.
FOREIGN_WORDS = 5
_MESSAGE = ["conv_id", "turn", "r", "tk"]


def _said(passage: Column) -> Column:
    """Case, spacing and marks aside, what a passage says."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def _computed(rows: DataFrame, **cols: Column) -> DataFrame:
    """``rows`` with columns that are computed once, however often later expressions use them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def _lined(messages: DataFrame) -> DataFrame:
    """``messages`` with ``_raw``, the lines, ``_lines``, their quote levels and what follows the marks, and ``_blocks``, where quoted stretches begin.

    In a code fence no line is quoted.
    """
    rows = _computed(messages, _raw=F.split("text", "\n"))
    rows = _computed(rows, _fences=F.filter(F.sequence(F.lit(0), F.size("_raw") - 1), lambda i: F.get("_raw", i).rlike(FENCE)))
    fenced = lambda i: F.size(F.filter("_fences", lambda f: f < i)) % 2 == 1
    mark = lambda x, i: F.when(x.rlike(MARKS) & ~fenced(i), F.regexp_extract(x, MARKS, 0)).otherwise("")
    rows = _computed(rows, _marks=F.transform("_raw", mark))
    rows = _computed(rows, _lines=F.zip_with("_raw", "_marks", lambda x, m: F.struct(F.length(F.regexp_replace(m, "[^>]", "")).alias("level"), F.substring(x, F.length(m) + 1, F.length(x)).alias("line"))))
    rows = _computed(rows, _blocks=F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (_level(i) > 0) & (F.coalesce(_level(i - 1), F.lit(0)) == 0)))
    return rows.drop("_fences", "_marks")


def _level(i: Column) -> Column:
    """The quote level of line i; null beside the ends."""
    return F.when(i >= 0, F.get("_lines", i)["level"])


def _block(i: Column) -> Column:
    """The number of blocks that have begun at line i, so a quoted line's block, from 1."""
    return F.size(F.filter("_blocks", lambda b: b <= i))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``runs``: the stretches of lines of one quote level, as (level, block, lines); a block is a whole quoted stretch."""
    rows = _lined(messages)
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (_level(i) != _level(i - 1)))
    rows = _computed(rows, _starts=starts)
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    runs = F.transform("_starts", lambda i, k: F.struct(_level(i).alias("level"), _block(i).alias("block"), F.transform(F.slice("_lines", i + 1, end(k) - i), lambda x: x["line"]).alias("lines")))
    return _computed(rows, runs=runs).drop("_raw", "_lines", "_starts", "_blocks")


def unquoted(messages: DataFrame) -> DataFrame:
    """``messages`` with ``bare``: the text without the blocks whose numbers are in ``cut``, and as it is where ``cut`` is null.

    A line that introduces a block goes with it, at most one blank line between; blank lines left around go too.
    """
    rows = _lined(messages)
    gone = lambda n: F.array_contains("cut", n)
    follows = lambda i: (_level(i + 1) > 0) | ((F.trim(F.get("_raw", i + 1)) == "") & (_level(i + 2) > 0))
    dropped = lambda x, i: F.when(_level(i) > 0, gone(_block(i))).otherwise(x.rlike(LEAD_IN) & F.coalesce(follows(i), F.lit(False)) & gone(_block(i) + 1))
    own = F.filter("_raw", lambda x, i: ~dropped(x, i))
    clean = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return rows.withColumn("bare", F.when(F.col("cut").isNull(), F.col("text")).otherwise(clean)).drop("_raw", "_lines", "_blocks")


def passages(rows: DataFrame, *cols: str) -> DataFrame:
    """``rows(cols, level, lines)`` to one row per distinct passage: ``said`` and its ``words``.

    The passages of a stretch are its lines, its sentences across line breaks, and the whole, so that quotes
    are found that were wrapped anew or hold a part.
    """
    whole = F.array_join("lines", "\n")
    sentences = F.split(F.regexp_replace(whole, "\n", " "), r"[.!?]+(?:\s|$)")
    each = rows.select(*cols, "level", F.explode(F.array_union(F.array_union("lines", sentences), F.array(whole))).alias("passage"))
    said = each.select(*cols, "level", _said(F.col("passage")).alias("said")).where("said <> ''")
    return said.select(*cols, "level", F.xxhash64("said").alias("h"), F.size(F.split("said", " ")).alias("words"))


def _placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 1) in their group by ``order``, however large a group is.

    Ranges of (group, order) are counted, and what comes before a range is added to the places in it; a group is spread over as
    many tasks as it has ranges.
    """
    dealt = Cut(rows.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()), "ranges").df
    sizes = dealt.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(group, "_p", (F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")).alias("_before"))
    here = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy(*order)))
    return here.join(before, [group, "_p"]).withColumn("position", (F.col("_r") + F.col("_before")).cast("long")).drop("_p", "_r", "_before")


def _turns_before(nodes: DataFrame) -> DataFrame:
    """``nodes(conv_id, turn)``, distinct, with ``prev``: the turn before."""
    dealt = Cut(nodes.repartitionByRange("conv_id", "turn").withColumn("_p", F.spark_partition_id()), "turns").df
    lasts = dealt.groupBy("conv_id", "_p").agg(F.max("turn").alias("_last"))
    back = lasts.select("conv_id", "_p", F.lag("_last").over(Window.partitionBy("conv_id").orderBy("_p")).alias("_back"))
    here = dealt.withColumn("_lag", F.lag("turn").over(Window.partitionBy("conv_id", "_p").orderBy("turn")))
    return here.join(back, ["conv_id", "_p"]).select("conv_id", "turn", F.coalesce("_lag", "_back").alias("prev"))


def _links(keyed: DataFrame) -> DataFrame:
    """``(conv_id, turn, r, tk, best, quote_depth, quoted, found, cut)`` of the messages that quote; ``cut`` are the linked blocks."""
    quoting = _computed(parsed(keyed.where("quotes")), run=F.col("runs")).select(*_MESSAGE, F.explode("run").alias("run"))
    runs = Cut(quoting.select(*_MESSAGE, "run.level", "run.block", "run.lines"), "runs").df
    quoted = Cut(passages(runs.where("level > 0"), *_MESSAGE, "block").distinct(), "quoted").df
    # only passages that someone quotes are kept of all the messages' own
    plain = keyed.where("not quotes and text is not null").select("conv_id", "turn", F.lit(0).alias("level"), F.split("text", "\n").alias("lines"))
    own = passages(plain.unionByName(runs.where("level = 0").select("conv_id", "turn", "level", "lines")), "conv_id", "turn")
    own = own.select("conv_id", "turn", "h").join(quoted.select("h").distinct(), "h", "left_semi")
    here = Cut(own.groupBy("h", "conv_id").agg(F.min("turn").alias("near")), "originals").df
    # the two first conversations of a passage, one of which is not the quoter's own
    first = here.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("conv_id"))).where("k <= 2")
    far = first.groupBy("h").agg(F.max(F.when(F.col("k") == 1, F.struct("conv_id", F.col("near").alias("turn")))).alias("one"), F.max(F.when(F.col("k") == 2, F.struct("conv_id", F.col("near").alias("turn")))).alias("two"))
    found = quoted.join(here, ["h", "conv_id"], "left").join(far, "h", "left")
    inside = F.coalesce(F.col("near") < F.col("turn"), F.lit(False))
    other = F.when(F.col("words") >= FOREIGN_WORDS, F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two")))
    found = found.select(
        *_MESSAGE, "block", "level", "h", "words", F.when(inside, F.col("conv_id")).otherwise(other["conv_id"]).alias("reply_conv"), F.when(inside, F.col("near")).otherwise(other["turn"]).alias("reply_turn"),
    )
    found = Cut(found, "found").df
    cut = found.where("reply_turn is not null").groupBy(*_MESSAGE).agg(F.sort_array(F.collect_set("block")).alias("cut"))
    votes = found.drop("block").distinct().groupBy(*_MESSAGE, "level", "reply_conv", "reply_turn").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    named = F.col("reply_turn").isNotNull()
    told = votes.groupBy(*_MESSAGE).agg(
        F.max("level").alias("quote_depth"), F.sum("n").alias("quoted"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("found"),
        F.min(F.when(named, F.struct("level", (-F.col("words")).alias("less"), (F.col("reply_conv") != F.col("conv_id")).alias("far"), (-F.col("reply_turn")).alias("late"), "reply_conv", "reply_turn"))).alias("best"),
    )
    return told.join(cut, _MESSAGE, "left")


def _threads(nodes: DataFrame) -> DataFrame:
    """``nodes(conv_id, turn, reply_conv, reply_turn)``, one per turn, with ``thread_id`` and ``depth``.

    Conversations that replies connect are one thread. Only in those does depth count: a reply is one deeper than
    what it replies to, found by pointer doubling. Where replies lead round in a circle, the least turn of it starts anew.
    """
    far = nodes.where("reply_conv <> conv_id").select(F.col("conv_id").alias("src"), F.col("reply_conv").alias("dst"))
    alone = nodes.select("conv_id", "turn", F.col("conv_id").alias("thread_id"), F.lit(0).cast("long").alias("depth"))
    joined = Cut(far.distinct(), "far").df
    if joined.isEmpty():
        return alone
    groups = Cut(connected_components(joined).toDF("conv_id", "thread_id"), "threads").df
    start = nodes.join(groups, "conv_id").select("thread_id", F.struct("conv_id", "turn").alias("x"), F.when(F.col("reply_turn").isNotNull(), F.struct(F.col("reply_conv").alias("conv_id"), F.col("reply_turn").alias("turn"))).alias("up"))
    start = Cut(start, "nodes").df

    def doubled(rows: DataFrame, join) -> DataFrame:
        """``rows(x, up, v)`` until pointers end, or have gone further than there are rows."""
        n, step = rows.count(), 1
        while step <= n and not rows.where("up is not null").isEmpty():
            ahead = rows.select(F.col("x").alias("up"), F.col("up").alias("up2"), F.col("v").alias("v2"))
            rows = Cut(rows.join(ahead, "up", "left").select("x", F.col("up2").alias("up"), join(F.col("v"), F.col("v2")).alias("v")), "doubled").df
            step *= 2
        return rows

    least = doubled(start.select("x", "up", F.least("x", F.coalesce("up", "x")).alias("v")), lambda a, b: F.least(a, F.coalesce(b, a)))
    # after so many steps every pointer left is in a circle, and what is least from there on is least of the circle
    circle = least.where("up is not null").select(F.col("up").alias("x")).distinct().join(least.select("x", "v"), "x")
    cut = circle.select(F.col("v").alias("x")).distinct().withColumn("cut", F.lit(True))
    open_ = Cut(start.join(cut, "x", "left").select("thread_id", "x", F.when(F.col("cut").isNull(), F.col("up")).alias("up")), "open").df
    depth = doubled(open_.select("x", "up", F.col("up").isNotNull().cast("long").alias("v")), lambda a, b: a + F.coalesce(b, F.lit(0)))
    deep = open_.select("x", "thread_id").join(depth, "x").select("x.conv_id", "x.turn", "thread_id", F.col("v").alias("depth"))
    return alone.join(groups.select("conv_id"), "conv_id", "left_anti").unionByName(deep)


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``, without what it quotes, linked and in reply order.

    A stretch of quoted lines (any depth of marks) of which a passage is found in an original is cut from the text, with a line that introduces it
    and the blank lines left around. Stretches of which nothing is found stay as they are, as no other message has what they say: shell and
    interpreter prompts, for one. In code fences nothing is quoted. The quoted passages (see ``passages``), normalised and hashed, are looked up among the messages' own: the original
    is the earliest message of the same conversation before this one that has it, else, for a passage of FOREIGN_WORDS words, the earliest of the least other
    conversation. What most words of the outermost quote level present (the least marks) name is what the message replies to; without one it
    replies to the turn before.

    Result: ``conv_id, turn, role, text, thread_id, position, reply_conv, reply_turn, linked, quote_depth,
    quoted_passages, linked_passages``. ``linked`` tells quotation links from the default. Conversations that links connect are one
    thread, named by its least conv_id; ``position`` (from 1) is the message's place in the thread, in which each reply comes after what it
    replies to (see ``_threads``); a thread of one conversation goes by turn.

    Rows without conv_id or turn stay, without thread, position and reply, as they are. Null text gives null text; empty text stays empty.
    Several rows of one (conv_id, turn) follow each other in the order of role (null first) and md5 of the text, and of their links the first one's
    places them all; rows repeated whole share one place. Other columns are ignored; an empty table gives an empty result. Texts of any length are
    read whole. Passages that many messages hold are reduced to their earliest holders before any join; long conversations are placed by ranges.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({
        "r": F.coalesce("role", F.lit("")), "tk": F.coalesce(F.md5("text"), F.lit("")), "quotes": F.coalesce(F.col("text").rlike(QUOTES), F.lit(False)),
    })
    known = rows.where("conv_id is not null and turn is not null")
    if rows.where("quotes").isEmpty():  # then no message links to another
        links = rows.sparkSession.createDataFrame([], "conv_id long, turn long, r string, tk string, best struct<level:int,less:long,far:boolean,late:long,reply_conv:long,reply_turn:long>, quote_depth int, quoted long, found long, cut array<int>")
    else:
        links = Cut(_links(known), "reply-links").df
    keys = Cut(known.select(*_MESSAGE).distinct(), "messages").df
    told = keys.join(links.drop("cut"), _MESSAGE, "left")
    first = told.groupBy("conv_id", "turn").agg(F.min(F.struct("r", "tk", "best")).alias("first"))
    turns = _turns_before(first.select("conv_id", "turn"))
    nodes = first.select("conv_id", "turn", "first.best").join(turns, ["conv_id", "turn"])
    linked = F.col("best").isNotNull()
    reply_conv = F.when(linked, F.col("best.reply_conv")).when(F.col("prev").isNotNull(), F.col("conv_id"))
    reply_turn = F.when(linked, F.col("best.reply_turn")).otherwise(F.col("prev"))
    nodes = Cut(nodes.select("conv_id", "turn", "prev", reply_conv.alias("reply_conv"), reply_turn.alias("reply_turn")), "replies").df
    threads = _threads(nodes.select("conv_id", "turn", "reply_conv", "reply_turn"))
    place = told.join(nodes.select("conv_id", "turn", "prev"), ["conv_id", "turn"]).join(threads, ["conv_id", "turn"])
    place = _placed(place, "thread_id", ["depth", "conv_id", "turn", "r", "tk"])
    place = place.select(*_MESSAGE, "thread_id", "position", reply_conv.alias("reply_conv"), reply_turn.alias("reply_turn"), linked.alias("linked"), "quote_depth", "quoted", "found")
    bare = unquoted(rows.where("quotes").join(links.select(*_MESSAGE, "cut"), _MESSAGE, "left")).select("conv_id", "turn", "role", F.col("bare").alias("text"), "r", "tk")
    texts = rows.where("not quotes").select("conv_id", "turn", "role", "text", "r", "tk").unionByName(bare)
    out = texts.join(place, _MESSAGE, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id", "turn", "role", "text", "thread_id", "position", "reply_conv", "reply_turn", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), zero("quoted").alias("quoted_passages"), zero("found").alias("linked_passages"),
    )


#: DuckDB's form of ``link_quotes`` over {messages}.
QUOTES_SQL = r"""
with recursive m as (select conv_id::bigint as conv_id, turn::bigint as turn, role, text, coalesce(role, '') as r, coalesce(md5(text), '') as tk, coalesce(regexp_matches(text, '(?:^|\n)(?:[ \t]{{0,3}}>)'), false) as q from {messages}),
d as (select row_number() over () as id, * from (select distinct * from m where text is not null)),
raws as (select id, q, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i from d),
fenced as (select *, coalesce(sum(case when regexp_matches(raw, '^[ \t]{{0,3}}(?:```|~~~)') then 1 else 0 end) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as code from raws),
marks as (select *, case when code then '' else regexp_extract(raw, '^(?:[ \t]{{0,3}}>)+') end as mark from fenced),
lines as (select *, length(regexp_replace(mark, '[^>]', '', 'g')) as level, substr(raw, length(mark) + 1) as line from marks),
near as (select *, lag(level) over w as before, lead(level) over w as next, lead(raw) over w as next_raw, lead(level, 2) over w as after from lines window w as (partition by id order by i)),
around as (select *, sum(case when level > 0 and coalesce(before, 0) = 0 then 1 else 0 end) over (partition by id order by i) as block from near),
runs as (select *, sum(case when level is distinct from before then 1 else 0 end) over (partition by id order by i) as run from around),
wholes as (select id, run, any_value(level) as level, any_value(block) as block, string_agg(line, chr(10) order by i) as whole from runs group by id, run),
parts as (select id, level, block, line as p from runs union all select id, level, block, whole from wholes union all select id, level, block, unnest(string_split_regex(replace(whole, chr(10), ' '), '[.!?]+(?:\s|$)')) from wholes),
said as (select distinct d.conv_id, d.turn, d.r, d.tk, level, block, trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) as said from parts join d using (id) where conv_id is not null and turn is not null),
quoted as (select *, len(string_split(said, ' ')) as words from said where level > 0 and said <> ''),
here as (select said, conv_id, min(turn) as near from said where level = 0 group by all),
ordered as (select *, row_number() over (partition by said order by conv_id) as k from here),
found as (select q.conv_id, q.turn, q.r, q.tk, q.level, q.block, q.said, q.words, case when h.near < q.turn then q.conv_id when q.words >= 5 then f.conv_id end as reply_conv, case when h.near < q.turn then h.near when q.words >= 5 then f.near end as reply_turn
  from quoted q left join here h on h.said = q.said and h.conv_id = q.conv_id
  left join ordered a on a.said = q.said and a.k = 1 left join ordered f on f.said = q.said and f.k = case when a.conv_id <> q.conv_id then 1 else 2 end),
cuts_ as (select distinct d.id, f.block from found f join d on d.conv_id = f.conv_id and d.turn = f.turn and d.r = f.r and d.tk = f.tk where f.reply_turn is not null),
kept as (select a.id, string_agg(a.raw, chr(10) order by a.i) as t from around a left join cuts_ c on c.id = a.id and c.block = case when a.level > 0 then a.block else a.block + 1 end
  where not (c.block is not null and (a.level > 0 or (regexp_matches(a.raw, '(?i)^\s*(?:on .{{1,200}}\bwrote|.{{1,80}}\b(?:wrote|writes|said|schrieb|a écrit|escribió))\s*:\s*$') and coalesce(a.next > 0 or (trim(a.next_raw) = '' and a.after > 0), false)))) group by a.id),
bares as (select d.id, case when d.id in (select id from cuts_) then regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') else d.text end as bare from d left join kept using (id) where q),
votes as (select conv_id, turn, r, tk, level, reply_conv, reply_turn, count(*) as n, sum(words) as words from (select distinct conv_id, turn, r, tk, level, said, words, reply_conv, reply_turn from found) group by all),
totals as (select conv_id, turn, r, tk, max(level) as depth, sum(n) as quoted, coalesce(sum(n) filter (where reply_turn is not null), 0) as found from votes group by all),
best as (select * from votes where reply_turn is not null qualify row_number() over (partition by conv_id, turn, r, tk order by level, words desc, reply_conv <> conv_id, reply_turn desc, reply_conv) = 1),
told as (select k.*, b.reply_conv as bc, b.reply_turn as bt, t.depth as quote_depth, t.quoted, t.found from (select distinct conv_id, turn, r, tk from m where conv_id is not null and turn is not null) k
  left join best b on b.conv_id = k.conv_id and b.turn = k.turn and b.r = k.r and b.tk = k.tk left join totals t on t.conv_id = k.conv_id and t.turn = k.turn and t.r = k.r and t.tk = k.tk),
firsts as (select conv_id, turn, bc, bt from told qualify row_number() over (partition by conv_id, turn order by r, tk) = 1),
prevs as (select *, lag(turn) over (partition by conv_id order by turn) as prev from firsts),
nodes as (select conv_id, turn, prev, case when bt is not null then bc when prev is not null then conv_id end as uc, case when bt is not null then bt else prev end as ut from prevs),
ties as (select distinct conv_id as a, uc as b from nodes where uc <> conv_id union select distinct uc, conv_id from nodes where uc <> conv_id),
reach as (select a, a as b from ties union select reach.a, ties.b from reach join ties on reach.b = ties.a),
groups as (select a as conv_id, min(b) as thread_id from reach group by a),
inner_ as (select n.* from nodes n join groups using (conv_id)),
path as (select conv_id, turn, uc, ut from inner_ where ut is not null union select p.conv_id, p.turn, n.uc, n.ut from path p join inner_ n on n.conv_id = p.uc and n.turn = p.ut where n.ut is not null),
cuts as (select conv_id, turn from path group by all having bool_or(uc = conv_id and ut = turn) and min((uc, ut)) >= (conv_id, turn)),
opened as (select i.*, c.turn is not null as cut from inner_ i left join cuts c on c.conv_id = i.conv_id and c.turn = i.turn),
deep as (select conv_id, turn, 0 as depth from opened where cut or ut is null union all select o.conv_id, o.turn, p.depth + 1 from opened o join deep p on o.uc = p.conv_id and o.ut = p.turn where not o.cut),
placed as (select t.*, n.prev, coalesce(g.thread_id, t.conv_id) as thread_id, dense_rank() over (partition by coalesce(g.thread_id, t.conv_id) order by coalesce(p.depth, 0), t.conv_id, t.turn, t.r, t.tk) as position
  from told t join nodes n on n.conv_id = t.conv_id and n.turn = t.turn left join groups g on g.conv_id = t.conv_id left join deep p on p.conv_id = t.conv_id and p.turn = t.turn)
select m.conv_id, m.turn, m.role, case when m.q then b.bare else m.text end as text, p.thread_id, p.position, case when p.bt is not null then p.bc when p.prev is not null then p.conv_id end as reply_conv, coalesce(p.bt, p.prev) as reply_turn,
  p.bt is not null as linked, coalesce(p.quote_depth, 0)::int as quote_depth, coalesce(p.quoted, 0)::bigint as quoted_passages, coalesce(p.found, 0)::bigint as linked_passages
from m left join (select d.*, bare from d join bares using (id)) b on m.q and b.conv_id is not distinct from m.conv_id and b.turn is not distinct from m.turn and b.role is not distinct from m.role and b.tk = m.tk
left join placed p on p.conv_id = m.conv_id and p.turn = m.turn and p.r = m.r and p.tk = m.tk
"""
