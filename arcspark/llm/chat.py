"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that begin with '>' are quoted, one level for each '>'. Quoted passages
(lines, normalised) of every level are hashed and joined, within a
conversation, to the earliest message that holds the passage as its own. A
message answers the message from which most of its outermost linked quotes
come; without a quote that links, it answers the turn before.

The conversation comes out in reply order: each message is followed by all
that answers it, directly or not, earlier answers first. Runs of turns that
each answer the one before are one segment; segments form a tree, whose tour
(in and out of each segment) is a linked list. Pointer doubling finds where
each message's segment begins, its root and depth, and its place in the tour,
so neither a conversation nor a path through it is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm.common import materialize, new_scope, sweep

#: Quote marks at a line's start; blank characters that normalising folds.
MARKS, BLANKS = r"^[ \t]*(>[> \t]*)", r"[ \t\r]+"
#: Values that one window partition orders.
BLOCK = 4096


def lines_of(text: Column) -> Column:
    """array of (level, body): how deep a line is quoted, and the line without its marks."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.length(F.translate(marks(x), " \t", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")))


def normalised(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, BLANKS, " ")))


def linked(messages: DataFrame, scope: str | None = None) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked, quoted_turns), one row for each conversation and turn."""
    lines = messages.select("conv_id", "turn", F.explode(lines_of(F.col("text"))).alias("line"))
    lines = lines.select("conv_id", "turn", "line.level", normalised(F.col("line.body")).alias("body")).where(F.col("body") != "")
    passages = lines.select("conv_id", "turn", "level", F.sha2("body", 256).alias("passage"))
    quotes = passages.where(F.col("level") > 0).groupBy("conv_id", F.col("turn").alias("by"), "passage").agg(F.min("level").alias("level"))
    quotes = materialize(quotes, "quotes", scope)
    # only what someone quotes can be an original; the filter leaves few rows to group
    wanted = quotes.select("conv_id", "passage").distinct()
    own = passages.where(F.col("level") == 0).join(wanted, ["conv_id", "passage"], "left_semi")
    first = own.groupBy("conv_id", "passage").agg(F.min("turn").alias("turn"))
    votes = quotes.join(first, ["conv_id", "passage"]).where(F.col("turn") < F.col("by"))
    votes = votes.groupBy("conv_id", "by", "level", "turn").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", F.col("by").alias("turn")).agg(F.max(F.struct((-F.col("level")).alias("outer"), "n", "turn")).alias("best"), F.array_sort(F.collect_set("turn")).alias("quoted_turns"))
    nodes = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    found = nodes.join(before, ["conv_id", "turn"], "left").join(best, ["conv_id", "turn"], "left")
    return found.select("conv_id", "turn", F.coalesce("best.turn", "previous").alias("parent_turn"), F.coalesce("best.n", F.lit(0)).cast("long").alias("n_linked"), F.array_join("quoted_turns", ",").alias("quoted_turns"))


def doubled(rows: DataFrame, scope: str | None) -> DataFrame:
    """Rows (conv_id, id, next, sum): each ``sum`` plus those of all rows that ``next`` leads to; ``next`` becomes the last of them.

    A null ``next`` ends the way. As many rounds as the logarithm of the longest.
    """
    now = materialize(rows.select("conv_id", "id", "next", "sum", F.coalesce("next", "id").alias("last")), "doubled", scope)
    while not now.where("next IS NOT NULL").isEmpty():
        ahead = now.select("conv_id", F.col("id").alias("next"), F.col("next").alias("then"), F.col("sum").alias("more"), F.col("last").alias("end"))
        moving = now.where("next IS NOT NULL").join(ahead, ["conv_id", "next"])
        moving = moving.select("conv_id", "id", F.col("then").alias("next"), (F.col("sum") + F.col("more")).alias("sum"), F.col("end").alias("last"))
        now = materialize(now.where("next IS NULL").unionByName(moving), "doubled", scope)
    return now.select("conv_id", "id", "sum", "last")


def followed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` and ``after``: the next larger ``value`` among rows of equal ``keys``.

    Values are ordered in blocks of BLOCK, and the blocks by their first
    value, so that no window holds more than a block or a value for each.
    """
    cut = rows.withColumn("block", F.floor(F.col(value) / BLOCK))
    near = cut.withColumn("near", F.lead(value).over(Window.partitionBy(*keys, "block").orderBy(value)))
    blocks = cut.groupBy(*keys, "block").agg(F.min(value).alias("first"))
    blocks = blocks.withColumn("far", F.lead("first").over(Window.partitionBy(*keys).orderBy("block"))).drop("first")
    return near.join(blocks, [*keys, "block"]).withColumn("after", F.coalesce("near", "far")).drop("block", "near", "far")


def reply_order(links: DataFrame, scope: str | None = None) -> DataFrame:
    """(conv_id, turn, parent_turn) -> (conv_id, turn, root_turn, depth, reply_order)."""
    goes_on = F.coalesce(F.col("parent_turn") == F.col("turn") - 1, F.lit(False))
    chain = doubled(links.select("conv_id", F.col("turn").alias("id"), F.when(goes_on, F.col("parent_turn")).alias("next"), F.when(goes_on, 1).otherwise(0).cast("long").alias("sum")), scope)
    placed = materialize(chain.select("conv_id", F.col("id").alias("turn"), F.col("last").alias("head"), F.col("sum").alias("offset")), "chat-placed", scope)
    sizes = placed.groupBy("conv_id", "head").agg(F.count("*").alias("size"))
    heads = links.where(~goes_on).select("conv_id", F.col("turn").alias("head"), F.col("parent_turn").alias("attach"))
    above = placed.select("conv_id", F.col("turn").alias("attach"), F.col("head").alias("above"), F.col("offset").alias("at"))
    segments = heads.join(sizes, ["conv_id", "head"]).join(above, ["conv_id", "attach"], "left")
    segments = materialize(segments, "chat-segments", scope)  # conv_id, attach, head, size, above, at

    up = segments.select("conv_id", F.col("head").alias("id"), F.col("above").alias("next"), F.coalesce(F.col("at") + 1, F.lit(0)).cast("long").alias("sum"))
    up = doubled(up, scope).select("conv_id", F.col("id").alias("head"), F.col("last").alias("root_turn"), F.col("sum").alias("base"))

    # after a segment come the answers to its last turn, then to the one before, and so on
    into, out = F.col("head") * 2, F.col("head") * 2 + 1
    roots = followed(segments.where("above IS NULL").select("conv_id", "head"), ["conv_id"], "head").select("conv_id", "head", F.lit(None).cast("long").alias("above"), (F.col("after") * 2).alias("next"))
    answers = followed(segments.where("above IS NOT NULL").select("conv_id", "above", "attach", "head"), ["conv_id", "attach"], "head")
    points = answers.groupBy("conv_id", "above", "attach").agg(F.min("head").alias("first")).withColumn("back", -F.col("attach"))
    lower = followed(points, ["conv_id", "above"], "back")
    lower = lower.select("conv_id", "above", "attach", (-F.col("after")).alias("lower")).join(points.select("conv_id", F.col("attach").alias("lower"), F.col("first").alias("further")), ["conv_id", "lower"], "left")
    answers = answers.join(lower.select("conv_id", "attach", "further"), ["conv_id", "attach"])
    answers = answers.select("conv_id", "head", "above", (F.coalesce("after", "further") * 2).alias("next"))
    leaving = roots.unionByName(answers).select("conv_id", out.alias("id"), F.coalesce("next", F.col("above") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("sum"))
    first = points.groupBy("conv_id", F.col("above").alias("head")).agg(F.max(F.struct("attach", "first")).alias("child"))
    entering = segments.join(first, ["conv_id", "head"], "left").select("conv_id", into.alias("id"), F.coalesce(F.col("child.first") * 2, out).alias("next"), F.col("size").alias("sum"))
    tour = doubled(entering.unionByName(leaving), scope).where("id % 2 = 0").select("conv_id", (F.col("id") / 2).cast("long").alias("head"), F.col("sum").alias("ahead"))

    totals = placed.groupBy("conv_id").agg(F.count("*").alias("total"))
    found = placed.join(up.join(tour, ["conv_id", "head"]), ["conv_id", "head"]).join(totals, "conv_id")
    return found.select("conv_id", "turn", "root_turn", (F.col("base") + F.col("offset")).alias("depth"), (F.col("total") - F.col("ahead") + F.col("offset")).alias("reply_order"))


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scope: str | None = None) -> DataFrame:
    """Per row: conv_id, turn, role, text (without quotes), parent_turn, root_turn, depth, reply_order, n_quotes, n_linked, quoted_turns.

    Rows come by conversation in reply order; no conversation is gathered into
    one row or task. A passage is a line; it links to the earliest message
    before that has it as its own, and deeper levels decide where outer ones
    link nothing. ``quoted_turns`` has the originals of all levels, '' if
    none. Of equal votes the later original wins. A null text is empty and
    quotes nothing. Rows without conversation or turn stay, as threads of
    their own at place 0. Rows that repeat a turn share its place; what any of
    them quotes counts. An empty table gives no rows; other columns are not
    looked at. A text is taken whole, as one array of its lines.
    """
    inner = new_scope("chat")
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    links = materialize(linked(rows, inner), "chat-links", inner)
    placed = materialize(links.join(reply_order(links, inner), ["conv_id", "turn"]), "chat-order", scope)
    sweep(messages.sparkSession, inner)
    lines = rows.select("conv_id", "turn", "role", lines_of(F.col("text")).alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    clean = lines.select("conv_id", "turn", "role", F.regexp_replace(own, r"^\n+|\n+$", "").alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"))
    zero = F.lit(0).cast("long")
    out = clean.join(placed, ["conv_id", "turn"], "left").withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", zero), "reply_order": F.coalesce("reply_order", zero), "n_linked": F.coalesce("n_linked", zero), "quoted_turns": F.coalesce("quoted_turns", F.lit(""))})
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "reply_order", "n_quotes", "n_linked", "quoted_turns").orderBy("conv_id", "reply_order", "turn")


def with_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) in which some replies quote: a fixture for tables that hold no quotes.

    Of turns from the second on, those with (conv_id's crc32 + turn) divisible by 3 begin
    with the first line of the turn two before, at level 1; those with
    remainder 1 with that of the conversation's turn 0, at level 2.
    """
    line = lambda t: F.regexp_extract(F.coalesce(t, F.lit("")), r"^([^\n]*)", 1)
    known = messages.groupBy("conv_id", "turn").agg(F.min(line(F.col("text"))).alias("line"))
    two = known.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("line").alias("two"))
    zero = known.where("turn = 0").select("conv_id", F.col("line").alias("zero"))
    kind = (F.crc32(F.col("conv_id").cast("string").cast("binary")) + F.col("turn")) % 3
    found = messages.join(two, ["conv_id", "turn"], "left").join(zero, "conv_id", "left")
    quote = F.when((F.col("turn") >= 2) & (kind == 0), F.concat(F.lit("> "), F.col("two"), F.lit("\n"))).when((F.col("turn") >= 2) & (kind == 1), F.concat(F.lit("> > "), F.col("zero"), F.lit("\n")))
    return found.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def format_sql(source: str = "SELECT * FROM conversations") -> str:
    """The same in DuckDB SQL; reply order is that of the paths from the root."""
    return rf"""
WITH RECURSIVE src AS (SELECT *, row_number() OVER () AS rid FROM ({source})),
l AS (SELECT conv_id, turn, regexp_extract(x, '^[ \t]*(>[> \t]*)', 1) AS marks, regexp_replace(x, '^[ \t]*(>[> \t]*)', '') AS body, i, rid
  FROM (SELECT conv_id, turn, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM src)),
p AS (SELECT *, length(translate(marks, ' ' || chr(9), '')) AS level, lower(trim(regexp_replace(body, '[ \t\r]+', ' ', 'g'))) AS norm FROM l),
q AS (SELECT conv_id, turn AS by_turn, norm, min(level) AS level FROM p WHERE level > 0 AND norm <> '' GROUP BY ALL),
o AS (SELECT conv_id, norm, min(turn) AS turn FROM p WHERE level = 0 AND norm <> '' GROUP BY ALL),
v AS (SELECT q.conv_id, by_turn, level, o.turn, count(*) AS n FROM q JOIN o ON q.conv_id = o.conv_id AND q.norm = o.norm AND o.turn < by_turn GROUP BY ALL),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, by_turn ORDER BY level, n DESC, turn DESC) = 1),
quoted AS (SELECT conv_id, by_turn, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM (SELECT DISTINCT conv_id, by_turn, turn FROM v) GROUP BY ALL),
nodes AS (SELECT DISTINCT conv_id, turn FROM src WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
links AS (SELECT a.conv_id, a.turn, coalesce(best.turn, b.turn) AS parent_turn, coalesce(n, 0) AS n_linked
  FROM nodes a LEFT JOIN nodes b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN best ON a.conv_id = best.conv_id AND a.turn = by_turn),
t AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth, [turn] AS path FROM links WHERE parent_turn IS NULL
  UNION ALL SELECT k.conv_id, k.turn, t.root_turn, t.depth + 1, list_append(t.path, k.turn) FROM t JOIN links k ON k.conv_id = t.conv_id AND k.parent_turn = t.turn),
places AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place FROM t),
m AS (SELECT rid, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN body END, chr(10) ORDER BY i), ''), '^\n+|\n+$', '', 'g') AS clean, count(*) FILTER (WHERE level > 0) AS n_quotes FROM p GROUP BY rid)
SELECT c.conv_id, CAST(c.turn AS BIGINT) AS turn, c.role, m.clean AS text, CAST(links.parent_turn AS BIGINT) AS parent_turn, CAST(coalesce(places.root_turn, c.turn) AS BIGINT) AS root_turn,
  CAST(coalesce(places.depth, 0) AS BIGINT) AS depth, CAST(coalesce(place, 0) AS BIGINT) AS reply_order, CAST(n_quotes AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, coalesce(quoted.turns, '') AS quoted_turns
FROM src c JOIN m USING (rid) LEFT JOIN quoted ON quoted.conv_id = c.conv_id AND quoted.by_turn = c.turn
LEFT JOIN links ON links.conv_id = c.conv_id AND links.turn = c.turn LEFT JOIN places ON places.conv_id = c.conv_id AND places.turn = c.turn
"""


FORMAT_SQL = format_sql()
#: ``with_quotes`` in SQL. Conversation ids are numbers or text; crc32 is spelt out bit by bit over their text.
QUOTED_SQL = format_sql(r"""
SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn >= 2 AND (crc + c.turn) % 3 = 0 THEN coalesce('> ' || two.line || chr(10), '') WHEN c.turn >= 2 AND (crc + c.turn) % 3 = 1 THEN coalesce('> > ' || zero.line || chr(10), '') ELSE '' END || coalesce(c.text, '') AS text
FROM conversations c
JOIN (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc FROM (SELECT DISTINCT conv_id FROM conversations)) k ON k.conv_id = c.conv_id
LEFT JOIN (SELECT conv_id, turn, min(string_split(coalesce(text, ''), chr(10))[1]) AS line FROM conversations GROUP BY ALL) two ON two.conv_id = c.conv_id AND two.turn + 2 = c.turn
LEFT JOIN (SELECT conv_id, min(string_split(coalesce(text, ''), chr(10))[1]) AS line FROM conversations WHERE turn = 0 GROUP BY ALL) zero ON zero.conv_id = c.conv_id
""")
