"""Quotation linking of chat messages; DataFrame functions only.

A message's lines are split by quote level (the count of leading ``>`` marks, with
blanks between them allowed). Unquoted lines make up the message's own text, but for
those that only say who wrote what is quoted below them. Text is normalised (marks
removed, white space runs as one space, trimmed, lower case), and passages of it are
hashed: each line, and each run of ``RUN`` words of a block (the lines of one level that
follow each other), so that a quote is found again where a mail client has wrapped it
anew. The original of a passage is the earliest message of the conversation whose own
text has it; a message replies to the earlier message that its outermost quote (the
smallest level that finds one) hits most often, ties to the later message. Messages
without a link are roots.

Reply order: a message comes after the one it replies to, replies to one message in
the order of their turns, and each with all of its own replies before the next. The
replies form trees, and a message's place in its tree (``reply_rank``) is its place
on the tour that enters and leaves each message once; tours are ranked by pointer
doubling over the linked messages only, so long chains cost as many joins as the
logarithm of their length and no string or array grows with them. A message's
``position`` in its conversation is the size of the trees whose roots are earlier,
plus its rank; these sums are made by 16 bits of the turn at a time, so no window
sees more than 65,536 rows, however long a conversation is.

``conversations`` builds the result: each conversation's messages without quotes in
reply order, ``PAGE`` messages a row at most. A page that has more rows, as rows repeat or
have no turn, is split into parts; rows of one place are numbered in salted steps.

Own passages are made only in conversations that quote, kept only if some message
quotes that hash, and are reduced to the earliest turn before the join, so a line that
a whole conversation repeats is one row; quoted passages are counted per message and
hash before they shuffle. A message that quotes nothing passes straight through.

Cases: null text counts as empty; blank lines aren't linked; a null conv_id is a
conversation of its own; a null turn takes no part in links and has the place of
turn 0; a quote without an original, or one only of itself or of later messages,
gives no link; repeated rows give the same link and position; turns may be negative
or of any size; very long messages are read whole; other columns are carried along,
but those of the results' names, which they replace; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, made, written

MARK = r"^[ \t]*(>[ \t]*)+"
MOST_ROUNDS = 64
PAGE, SALTS = 256, 64
#: Words of a run that is hashed.
RUN = 4
#: Lines that say who wrote what is quoted below.
SAID_BY = r"(?iu)^\s*(?:.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:|-{2,}\s*(?:original message|ursprüngliche nachricht|message d'origine|mensaje original)\s*-{2,})\s*$"
STEP = 16  # bits of the turn that a window of prefix sums spans
RESULTS = ("own_text", "reply_to", "n_quoted", "max_level", "root_turn", "reply_rank", "position")


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def _credits(all_: Column, i: Column) -> Column:
    """Whether line ``i`` says who wrote the quote below it (a blank line may stand between)."""
    line = lambda k: F.coalesce(F.get(all_, i + k), F.lit(""))
    return line(0).rlike(SAID_BY) & (line(1).rlike(MARK) | ((F.trim(line(1)) == "") & line(2).rlike(MARK)))


def lines(text: Column) -> Column:
    """array<struct<level, norm>> of a text's lines; norm is empty for blank ones and those that credit a quote."""

    def all_of(all_: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            marks = F.regexp_extract(line, MARK, 0)
            norm = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARK, ""), "[\\s\u0001\u0002]+", " ")))
            return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.when(_credits(all_, i), F.lit("")).otherwise(norm).alias("norm"))

        return F.transform(all_, one)

    return F.transform(F.array(_split(text)), all_of)[0]


def passages(text: Column) -> Column:
    """array<struct<level, hash, line>>: the lines of a text, and the runs of words of its blocks."""

    def both(parsed: Column) -> Column:
        begins = lambda i: F.coalesce((F.get(parsed, i - 1)["norm"] == "") | (F.get(parsed, i - 1)["level"] != F.get(parsed, i)["level"]), F.lit(True))
        marked = F.transform(parsed, lambda x, i: F.when(x["norm"] == "", "").otherwise(F.concat(F.when(begins(i), F.concat(F.lit("\u0001"), x["level"].cast("string"), F.lit("\u0002"))).otherwise(F.lit(" ")), x["norm"])))
        blocks = F.filter(F.split(F.array_join(marked, ""), "\u0001"), lambda b: b != "")
        runs = F.flatten(F.transform(F.transform(blocks, lambda b: F.split(b, "\u0002")), lambda b: _runs(b[0].cast("int"), F.split(b[1], " "))))
        whole = F.transform(F.filter(parsed, lambda x: x["norm"] != ""), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["norm"]).alias("hash"), F.lit(True).alias("line")))
        return F.concat(whole, runs)

    return F.transform(F.array(lines(text)), both)[0]


def _runs(level: Column, words: Column) -> Column:
    def made(w: Column) -> Column:
        at = F.when(F.size(w) > RUN, F.sequence(F.lit(0), F.size(w) - RUN)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(level.alias("level"), F.xxhash64(*[F.get(w, i + k) for k in range(RUN)], F.lit(RUN)).alias("hash"), F.lit(False).alias("line")))

    return F.transform(F.array(words), made)[0]


def own_text(text: Column) -> Column:
    """The text without quoted lines and those that credit them, trimmed; runs of blank lines that they leave are one."""
    own = F.transform(F.array(_split(text)), lambda a: F.filter(a, lambda x, i: ~x.rlike(MARK) & ~_credits(a, i)))[0]
    return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def links(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, reply_to, n_quoted, max_level) of each message that quotes; reply_to null if nothing was found."""
    parsed = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("turn is not null")
    quoted = (
        parsed.filter(F.col("text").rlike("(?m)" + MARK))
        .select("conv", "turn", F.explode(passages(F.col("text"))).alias("l"))
        .filter("l.level > 0")
        .groupBy("conv", "turn", F.col("l.hash").alias("hash"))
        .agg(F.min("l.level").alias("level"), F.max("l.level").alias("deepest"), F.count(F.lit(1)).alias("n"), F.count_if("l.line").alias("lines"))
    )
    quoted = written(quoted, "quoted")
    wanted = quoted.select("conv", "hash").distinct()
    quoting = quoted.select(F.col("conv").alias("quoting"), F.lit(1).alias("yes")).distinct()
    there = parsed.join(quoting, F.col("conv").eqNullSafe(F.col("quoting")), "left").filter("yes = 1")
    own = there.select("conv", "turn", F.explode(passages(F.col("text"))).alias("l")).filter("l.level = 0").select("conv", "turn", F.col("l.hash").alias("hash"))
    same = (F.col("w.hash") == F.col("o.hash")) & F.col("w.conv").eqNullSafe(F.col("o.conv"))
    first = own.groupBy("conv", "hash").agg(F.min("turn").alias("origin")).alias("o").join(wanted.alias("w"), same, "left_semi")
    hit = quoted.alias("w").join(first.alias("o"), (F.col("w.hash") == F.col("o.hash")) & F.col("w.conv").eqNullSafe(F.col("o.conv")), "left")
    hit = hit.select("w.conv", "w.turn", "w.level", "w.deepest", "w.n", "w.lines", F.when(F.col("origin") < F.col("w.turn"), F.col("origin")).alias("origin"))
    votes = hit.groupBy("conv", "turn", "origin", "level").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.max("deepest").alias("deepest"))
    best = F.min_by("origin", F.struct(F.col("origin").isNull(), "level", -F.col("n"), -F.col("origin")))
    return votes.groupBy("conv", "turn").agg(best.alias("reply_to"), F.sum("lines").alias("n_quoted"), F.max("deepest").alias("max_level"))


def _same(a: str, b: str, *on: str) -> Column:
    """Equality of the columns of two aliased sides; null conversations are equal."""
    out = F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    for c in on:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _next_siblings(edges: DataFrame) -> DataFrame:
    """(conv, turn, up, next): the next reply to the same message. Replies are dealt out by the higher bits of their turns."""
    high = F.shiftright("turn", STEP)
    inner = Window.partitionBy("conv", "up", high).orderBy("turn")
    blocks = edges.groupBy("conv", "up", high.alias("block")).agg(F.min("turn").alias("first"))
    after = blocks.select("conv", "up", "block", F.lead("first").over(Window.partitionBy("conv", "up").orderBy("block")).alias("after"))
    near = edges.withColumns({"near": F.lead("turn").over(inner), "block": high})
    met = near.alias("n").join(after.alias("b"), _same("n", "b", "up", "block"), "left")
    return met.select("n.conv", "n.turn", "n.up", F.coalesce("near", "after").alias("next"))


def ranks(linked: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, reply_rank, tree_size) of every message that replies or is replied to."""
    edges = linked.filter("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("up")).distinct()
    sib = written(_next_siblings(edges), "replies")
    first = sib.groupBy("conv", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = sib.select("conv", "turn").unionByName(first.select("conv", "turn")).distinct()
    enter = nodes.alias("n").join(first.alias("f"), _same("n", "f", "turn"), "left")
    enter = enter.select("n.conv", "n.turn", F.lit(0).alias("side"), F.coalesce("child", "n.turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("d"))
    leave = nodes.alias("n").join(sib.alias("s"), _same("n", "s", "turn"), "left")
    leave = leave.select("n.conv", "n.turn", F.lit(1).alias("side"), F.coalesce("next", "up").alias("to"), F.when(F.col("next").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("d"))
    tour = written(enter.unionByName(leave).withColumn("root", F.when(F.col("to").isNull(), F.col("turn"))), "tour")
    for _ in range(MOST_ROUNDS):
        if not tour.filter("to is not null").limit(1).count():
            break
        on = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.to") == F.col("b.turn")) & (F.col("a.to_side") == F.col("b.side"))
        step = tour.alias("a").join(tour.alias("b"), on, "left")
        tour = written(step.select("a.conv", "a.turn", "a.side", F.col("b.to").alias("to"), F.col("b.to_side").alias("to_side"), (F.col("a.d") + F.coalesce("b.d", F.lit(0))).alias("d"), F.coalesce("a.root", "b.root").alias("root")), "tour")
    else:
        raise RuntimeError("reply chains didn't end")
    inside = tour.filter("side = 0").select("conv", "turn", F.col("root").alias("root_turn"), F.col("d").alias("left"))
    whole = inside.filter("turn = root_turn").select("conv", F.col("root_turn"), F.col("left").alias("tree_size"))
    both = inside.alias("i").join(whole.alias("w"), _same("i", "w", "root_turn"))
    return both.select("i.conv", "i.turn", "i.root_turn", (F.col("tree_size") - F.col("left")).alias("reply_rank"), "tree_size")


def _before(sizes: DataFrame) -> DataFrame:
    """(conv, root_turn, before): the sum of the sizes of the conversation's trees whose root is earlier."""
    out = sizes.groupBy("conv", "root_turn").agg(F.max("size").alias("size"), F.lit(0).cast("long").alias("before"))
    out = written(out, "trees")
    total = out.select("conv", "root_turn", "before")
    for k in range(0, 64, STEP):
        at = F.shiftright("root_turn", k)
        cell = out.groupBy("conv", at.alias("cell")).agg(F.sum("size").alias("size"))
        up = F.shiftright("cell", STEP) if k + STEP < 64 else F.lit(0).cast("long")
        w = Window.partitionBy("conv", up).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        part = cell.select("conv", "cell", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("part"))
        met = total.withColumn("cell", at).alias("t").join(part.alias("p"), _same("t", "p", "cell"))
        total = met.select("t.conv", "t.root_turn", (F.col("before") + F.col("part")).alias("before"))
    return total


def placed(df: DataFrame, found: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    """(conv, turn, root_turn, reply_rank, position) of each message's place."""
    turn = F.coalesce(F.col(f"`{turn_col}`"), F.lit(0)).cast("long")
    all_ = df.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("turn")).distinct()
    tree = written(ranks(found), "ranks")
    known = all_.alias("m").join(tree.alias("t"), _same("m", "t", "turn"), "left")
    known = known.select("m.conv", "m.turn", F.coalesce("root_turn", "m.turn").alias("root_turn"), F.coalesce("reply_rank", F.lit(0)).cast("long").alias("reply_rank"), F.coalesce("tree_size", F.lit(1)).cast("long").alias("size"))
    known = written(known, "places")
    before = _before(known)
    met = known.alias("k").join(before.alias("b"), _same("k", "b", "root_turn"))
    return met.select("k.conv", "k.turn", "k.root_turn", "k.reply_rank", (F.col("before") + F.col("reply_rank")).alias("position"))


def threads(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Each message of ``df`` with own_text, reply_to, n_quoted, max_level, root_turn, reply_rank and position (see the module's docstring)."""
    mark = made()
    found = written(links(df, conv_col, turn_col, text_col), "links")
    places = placed(df, found, conv_col, turn_col)
    f, p = found.alias("f"), places.alias("p")
    known = p.join(f, _same("p", "f", "turn"), "left").select(F.col("p.conv").alias("__conv"), F.col("p.turn").alias("__turn"), "reply_to", "n_quoted", "max_level", "root_turn", "reply_rank", "position")
    known = written(known, "known")
    forget(df.sparkSession, mark, ("known",))
    rest = [c for c in df.columns if c.lower() not in RESULTS]
    message = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), own_text(F.col(f"`{text_col}`").cast("string")).alias("own_text"))
    met = message.join(known, F.col("conv").eqNullSafe(F.col("__conv")) & (F.coalesce("turn", F.lit(0)) == F.col("__turn")))
    real = F.col("turn").isNotNull()
    return met.select(
        "row.*", "own_text", F.when(real, F.col("reply_to")).cast("long").alias("reply_to"), F.when(real, F.coalesce("n_quoted", F.lit(0))).otherwise(0).cast("long").alias("n_quoted"),
        F.when(real, F.coalesce("max_level", F.lit(0))).otherwise(0).cast("int").alias("max_level"), "root_turn", "reply_rank", "position",
    )


def _parts(rows: DataFrame, page: int) -> DataFrame:
    """``rows`` with ``part``: 0 on pages of ``page`` rows or fewer; on others the rows are numbered in order and ``page`` of them are a part."""
    full = written(rows.groupBy("conv", "page").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > page), "fullpages")
    if not full.limit(1).count():
        return rows.withColumn("part", F.lit(0).cast("long"))
    met = rows.alias("r").join(full.alias("f"), F.col("r.conv").eqNullSafe(F.col("f.conv")) & (F.col("r.page") == F.col("f.page")), "left")
    all_ = met.select("r.*", F.col("size").isNotNull().alias("over"))
    over = written(all_.filter("over").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "overfull")
    # the first number of each (place, salt): a window over the salts of a place, and one over the places of a page
    cells = over.groupBy("conv", "page", "position", "salt").agg(F.count(F.lit(1)).alias("k"))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = cells.select("conv", "page", "position", "salt", before("k", "conv", "page", "position", "salt").alias("from"))
    places = cells.groupBy("conv", "page", "position").agg(F.sum("k").alias("k")).select("conv", "page", "position", before("k", "conv", "page", "position").alias("first"))
    start = inside.alias("i").join(places.alias("p"), _same("i", "p", "page", "position")).select("i.conv", "i.page", "i.position", "i.salt", (F.col("from") + F.col("first")).alias("start"))
    own = F.row_number().over(Window.partitionBy("conv", "page", "position", "salt").orderBy("m")) - 1
    numbered = over.withColumn("own", own).alias("o").join(start.alias("s"), _same("o", "s", "page", "position", "salt"))
    split = numbered.select("o.conv", "o.page", "o.position", "o.m", F.expr(f"(own + start) div {page}").alias("part"))
    return all_.filter("not over").select("conv", "page", "position", "m", F.lit(0).cast("long").alias("part")).unionByName(split)


def conversations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", page: int = PAGE) -> DataFrame:
    """(conv_id, page, part, n_messages, messages): each conversation's messages without quotes in reply order, ``page`` a row at most."""
    t = threads(df, conv_col=conv_col, turn_col=turn_col, text_col=text_col)
    role = [F.col(f"`{role_col}`").cast("string").alias("role")] if role_col else []
    one = F.struct("position", F.col(f"`{turn_col}`").cast("long").alias("turn"), *role, "reply_to", "n_quoted", F.col("own_text").alias("text"))
    rows = _parts(t.select(F.col(f"`{conv_col}`").alias("conv"), F.expr(f"position div {page}").alias("page"), "position", one.alias("m")), page)
    out = rows.groupBy("conv", "page", "part").agg(F.array_sort(F.collect_list("m")).alias("messages"))
    return out.select(F.col("conv").alias(conv_col), "page", "part", F.size("messages").cast("long").alias("n_messages"), "messages")
