"""Quotation linking for chat formatting, in DataFrame operations alone.

Lines that begin with `>` are quoted, one level per mark. Runs of lines of one
level are passages; their normalised text is hashed, as a whole and line by
line. A quoted hash belongs to the latest earlier message of its conversation
that wrote it unquoted: one pass of a window over (conversation, hash) finds
it, so a phrase that everybody writes and quotes makes no pairs. Messages lose
their quotes, reply to the message they quote most, and are ordered so that
threads stay together and every reply follows its original.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, stage

#: Fixed patterns: the marks of a quoted line, and a line that announces a quote.
MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"
ATTRIBUTION = -1


def normalised(text: Column) -> Column:
    """Lower case, with one space for whatever is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Runs of lines of one quote level: message, conv_id, turn, run, level, passage.

    Level 0 is the message's own text; -1 is a line that announces the quote
    that follows it. Messages without a quoted line are one run, as they are.
    """
    quoted = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]{0,3}>")
    plain = messages.filter(~quoted).select("message", "conv_id", "turn", F.lit(0).cast("long").alias("run"), F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("passage"))
    lines = messages.filter(quoted).select("message", "conv_id", "turn", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))
    w = Window.partitionBy("message").orderBy("pos")
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", "")))
    announces = (F.col("level") == 0) & F.col("line").rlike(ANNOUNCES) & (F.lead("level").over(w) > 0)
    lines = lines.withColumn("level", F.when(announces, ATTRIBUTION).otherwise(F.col("level")))
    changed = F.coalesce((F.col("level") != F.lag("level").over(w)).cast("long"), F.lit(0))
    lines = lines.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w)).withColumn("line", F.regexp_replace("line", MARKS, ""))
    grouped = lines.groupBy("message", "run").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return plain.unionByName(grouped.select("message", "conv_id", "turn", "run", "level", text.alias("passage")))


def _keys(found: DataFrame) -> DataFrame:
    """Distinct hashes of each message's passages and their lines and paragraphs, with what they weigh (characters)."""
    parts = F.concat(F.array("passage"), F.split("passage", "\n", -1), F.split("passage", r"\n[ \t]*\n", -1))
    norms = F.filter(F.array_distinct(F.transform(parts, normalised)), lambda x: x != "")
    out = found.filter("level >= 0").select("message", "conv_id", "turn", "level", F.explode(norms).alias("norm"))
    hashed = out.select("message", "conv_id", "turn", "level", F.xxhash64("norm", "conv_id").alias("k1"), F.xxhash64(F.lit(11), "norm", F.col("conv_id").isNull()).alias("k2"), F.length("norm").alias("weight"))
    return hashed.groupBy("message", "conv_id", "turn", "k1", "k2", (F.col("level") > 0).alias("quoted")).agg(F.min("level").alias("level"), F.max("weight").alias("weight"))


def _parted(df: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """df without the groups `by` of more than `most` rows, and those groups or None. df should be a written table.

    The groups that are large are fewer than df's rows / most; their names are
    broadcast, which is what bounds `most` from below on a large table.
    """
    large = df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*[F.col(c).alias(f"large_{c}") for c in by])
    if not large.limit(1).count():
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"large_{c}")) for c in by])
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def _sliced(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with `at`, which rises with (by, order), and `slice`, which tells the consecutive parts it is cut into."""
    keys = [*map(F.col, by), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return stage(rows, "slices").withColumn("slice", F.shiftright("at", 33))


def _origins(keys: DataFrame, slice_rows: int) -> DataFrame:
    """keys with o: turn and message of the latest earlier message that holds the hash unquoted."""
    by = ["k1", "k2"]
    order = [F.col("turn").asc_nulls_first(), F.col("quoted").desc(), F.col("message").asc()]
    own = F.when(~F.col("quoted"), F.struct("turn", F.col("message").alias("origin")))
    whole = lambda df, part, sort: df.withColumn("o", F.last(own, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)))
    usual, large = _parted(keys, by, slice_rows)
    out = whole(usual, by, order)
    if large is None:
        return out
    # a phrase that many write or quote: each slice looks back in itself, then at the last owner of the slices before
    cut = _sliced(large, by, order)
    last = cut.filter("not quoted").groupBy(*by, "slice").agg(F.max(F.struct("at", "turn", F.col("message").alias("origin"))).alias("m")).select(*by, "slice", "m")
    spans = cut.groupBy(*by, "slice").agg(F.count("*").alias("n")).join(last, [*by, "slice"], "left")
    before = F.last("m", ignorenulls=True).over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(*by, "slice", before.alias("carried"))
    local = whole(cut, [*by, "slice"], [F.col("at")]).join(carried, [*by, "slice"], "left")
    local = local.withColumn("o", F.coalesce("o", F.when(F.col("carried").isNotNull(), F.struct(F.col("carried.turn").alias("turn"), F.col("carried.origin").alias("origin")))))
    return out.unionByName(local.select(*out.columns))


def quote_links(found: DataFrame, slice_rows: int = 1 << 20) -> DataFrame:
    """For each message that quotes others: message, origin, level (least), weight, and quoted hashes found, one row per origin.

    The origin of a hash is the latest message of an earlier turn in the same
    conversation that holds it unquoted (of one turn, the greatest id). Null
    turns come before all others; null conv_ids are one conversation. A hash
    that a conversation bears more than slice_rows times is cut into slices.
    """
    keys = stage(_keys(found), "quotekeys")
    linked = _origins(keys, slice_rows).filter("quoted and o is not null and o.origin <> message")
    return linked.groupBy("message", F.col("o.origin").alias("origin")).agg(F.first("o.turn").alias("origin_turn"), F.min("level").alias("level"), F.sum("weight").alias("weight"), F.count("*").alias("hits"))


def _positions(rows: DataFrame, slice_rows: int) -> DataFrame:
    """(message, position) of rows (message, conv_id, root_turn, root, turn): places in each conversation, from 1."""
    order = [F.col("root_turn").asc_nulls_first(), F.col("root").asc(), F.col("turn").asc_nulls_first(), F.col("message").asc()]
    usual, large = _parted(rows, ["conv_id"], slice_rows)
    out = usual.select("message", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("position"))
    if large is None:
        return out
    # a conversation of very many messages: places in a slice, and the rows of the slices before
    cut = _sliced(large, ["conv_id"], order)
    spans = cut.groupBy("conv_id", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), "first", before.alias("before"))
    placed = cut.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
    return out.union(placed.select("message", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int")))


def _threads(replies: DataFrame) -> DataFrame:
    """(message, root, depth) of messages that reply, by pointer doubling over (message, origin)."""
    state = stage(replies.select("message", F.col("origin").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("message").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        nxt = state.join(up, "root", "left").select("message", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        nxt = stage(nxt, "threads")
        drop(state)
        if not nxt.filter("moved").limit(1).count():
            return nxt.drop("moved")
        path, state = nxt, nxt.drop("moved")
        state._kinweave_path = path._kinweave_path


def _message_key() -> Column:
    """128 bits for (conv_id, turn, role, text); what is null counts as such."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    string = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("|", number("conv_id"), number("turn"), string("role"), string("text")).cast("binary")))


def link_quotes(messages: DataFrame, slice_rows: int = 1 << 20) -> DataFrame:
    """Reply-ordered conversations without quotes, one row per message.

    messages has conv_id, turn, role and text; other columns are dropped, and
    rows equal in all four are one message. Returns conv_id, position (from 1
    in each conversation), turn, role, text (own lines only, blank ends
    stripped where quotes went; null for a null text), reply_turn (turn of the
    message it replies to, null if it quotes none), root_turn, depth (0 for a
    thread's first message), n_quotes (quoted passages) and n_linked (messages
    quoted and found).

    Threads come in the order of their first messages, and within a thread
    messages by turn; of equal turns, by the MD5 of the row. Conversations and
    phrases of more than slice_rows rows are cut into slices, so that no task
    takes one alone; the result is the same.
    """
    messages = messages.select("conv_id", "turn", "role", "text").dropDuplicates().withColumn("message", _message_key())
    found = passages(messages)
    links = stage(quote_links(found, slice_rows), "quotelinks")
    best = links.groupBy("message").agg(F.min(F.struct("level", (-F.col("weight")).alias("w"), (-F.coalesce("origin_turn", F.lit(0))).alias("t"), "origin", "origin_turn")).alias("b"), F.count("*").alias("n_linked"))
    replies = stage(best.select("message", F.col("b.origin").alias("origin"), F.col("b.origin_turn").alias("reply_turn"), "n_linked"), "replies")
    quoted = found.filter("level <> 0 or run > 0")
    touched = quoted.select("message").distinct()
    own = found.join(touched, "message", "left_semi").groupBy("message").agg(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "passage")))).alias("own"), F.count_if(F.col("level") > 0).alias("n_quotes"))
    body = F.regexp_replace(F.array_join(F.transform("own", lambda x: x["passage"]), "\n"), r"^\s+|\s+$", "")
    own = own.select("message", body.alias("body"), "n_quotes")
    threads = _threads(replies) if replies.limit(1).count() else replies.select("message", F.col("origin").alias("root"), F.lit(0).cast("long").alias("depth"))
    roots = messages.select(F.col("message").alias("root"), F.col("turn").alias("root_turn")).join(threads, "root").select("message", "root", "root_turn", "depth")
    first = F.when(F.col("root").isNull(), F.col("turn")).otherwise(F.col("root_turn"))
    slim = messages.select("message", "conv_id", "turn").join(roots, "message", "left").withColumn("root_turn", first).withColumn("root", F.coalesce("root", "message"))
    slim = stage(slim, "order")
    out = messages.join(own, "message", "left").join(replies.drop("origin"), "message", "left").join(slim.select("message", "root_turn", "depth"), "message").join(_positions(slim, slice_rows), "message")
    return out.select("conv_id", "position", "turn", "role", F.when(F.col("text").isNotNull(), F.coalesce("body", "text")).alias("text"), "reply_turn", "root_turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
