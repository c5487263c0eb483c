"""Quotation linking for chat (operator 7), in DataFrame functions alone.

A line's quote level is the number of `>` at its start. Passages are runs of non-blank lines of one
level, lower-cased and with white space squeezed, so re-wrapped quotes still meet; single lines of
a passage are passages too. Quoted passages are hashed and joined, within a conversation, to the
earliest message that says the passage itself. Passages of any length count. A message replies to the message before it that its
lowest matching quote level covers with most characters (of equals the later one). Replies form
threads; a conversation in reply order is sorted by (conv_id, thread_root, turn), so a reply follows
what it answers, and `position` counts its messages from 0 in that order. `content` is the message without quoted lines and without the attribution line
("On ... wrote:") above them.

Texts are parsed once and stored with what was found in them. Only the first sayer of a passage is
joined, so a passage said or quoted very often makes no pairs. Positions come from a range
partitioning, so a conversation of any size is numbered by many tasks.
Roots are found by doubling steps, as many as the logarithm of the deepest thread, over linked
messages alone.

Defined results: null and empty texts have empty content and no links; a message without a link is its own root; rows of null conv_id or turn
keep parent null and depth 0, with their own turn as root; repeated rows come back as often as
given and share their links and their position; of different rows with the same turn the least parent counts for the
thread; an empty table gives an empty result; other columns stay, but those named like a result column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orolith.functions.geo import let
from orolith.llm import common

MADE = ["content", "n_quoted", "n_linked", "parent_turn", "thread_root", "depth", "position"]
QUOTE = r"^[ \t>]*>"
#: Lines that announce a quotation.
ATTRIBUTION = r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|.{0,120}\b(?:wrote|writes|schrieb|a écrit|escribió))\s*:\s*$"


def parsed(text: Column) -> Column:
    """An array of (level, body, norm) for the lines of a message."""
    def line(x):
        prefix = F.regexp_extract(x, QUOTE, 0)
        return F.struct((F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))).alias("level"), F.regexp_replace(x, QUOTE + r"[ \t]?", "").alias("body"))

    with_norm = lambda s: F.struct(s.level.alias("level"), s.body.alias("body"), F.btrim(F.regexp_replace(F.lower(s.body), r"\s+", " ")).alias("norm"))
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), line), with_norm)


def content_of(lines: Column) -> Column:
    """Own lines, without attributions of the quotes below them and blank lines at the ends; of blank lines alone
    the last one stays. Lines are trimmed as an array, as a pattern that repeats lines overflows on many of them."""
    def own(x, i):
        below = F.get(lines, i + 1)
        announces = F.coalesce(below["level"] > 0, F.lit(False)) & x.norm.endswith(":") & x.norm.rlike(ATTRIBUTION)
        return (x.level == 0) & ~announces

    def trimmed(bodies):
        return let(F.filter(F.sequence(F.lit(0), F.size(bodies) - 1), lambda i: F.get(bodies, i).rlike(r"[^ \t]")), lambda full: F.when(F.size(full) > 0, F.slice(bodies, F.get(full, F.lit(0)) + 1, F.get(full, F.size(full) - 1) - F.get(full, F.lit(0)) + 1)).otherwise(F.slice(bodies, -1, 1)))

    bodies = F.transform(F.filter(lines, own), lambda x: x.body)
    return let(bodies, lambda b: F.when(F.size(b) > 0, F.concat_ws("\n", trimmed(b))).otherwise(F.lit("")))


def passages(lines: Column) -> Column:
    """An array of (level, h, size): each passage and each of its lines."""
    def begins(i):
        here, before = F.get(lines, i), F.get(lines, i - 1)
        return (here.norm != "") & ((i == 0) | (before.norm == "") | (before.level != here.level))

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)
    runs = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines))).alias("b"))

    def run(r):
        text = F.concat_ws(" ", F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x.norm))
        return F.struct(F.get(lines, r["a"]).level.alias("level"), F.btrim(F.regexp_replace(text, " +", " ")).alias("norm"))

    single = F.transform(F.filter(lines, lambda x: x.norm != ""), lambda x: F.struct(x.level.alias("level"), x.norm.alias("norm")))
    return F.transform(F.concat(F.when(F.size(starts) > 0, F.transform(runs, run)).otherwise(F.slice(single, 1, 0)), single), lambda p: F.struct(p.level.alias("level"), F.xxhash64(p.norm).alias("h"), F.length(p.norm).alias("size")))


def links(said: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, parent_turn, n_linked) for the messages whose quotes find an original,
    from (conv_id, turn, k1, k2, passages)."""
    said = said.select("conv_id", "turn", "k1", "k2", F.explode(F.array_distinct("passages")).alias("p")).select("conv_id", "turn", "k1", "k2", "p.*")
    quoted = said.where("level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    if quoted.isEmpty():
        return quoted.select("conv_id", "turn", "k1", "k2", F.col("turn").alias("parent_turn"), F.col("turn").alias("n_linked"))
    first = common.stored(said.where("level = 0").groupBy("conv_id", "h", "size").agg(F.min("turn").alias("origin")), "originals")
    met = quoted.join(first, ["conv_id", "h", "size"]).where("origin < turn")
    covered = met.groupBy("conv_id", "turn", "k1", "k2", "level", "origin").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    best = F.struct(F.col("level").alias("level"), (-F.col("chars")).alias("less"), (-F.col("origin")).alias("earlier"))
    return covered.groupBy("conv_id", "turn", "k1", "k2").agg(F.min_by("origin", best).alias("parent_turn"), F.sum("n").alias("n_linked"))


def roots(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_root, depth) from (conv_id, turn, parent_turn)."""
    up = linked.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up")).withColumn("depth", F.lit(1).cast("long"))
    up = common.stored(up, "threads")
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        if up.join(above, ["conv_id", "up"], "left_semi").isEmpty():
            return up.select("conv_id", "turn", F.col("up").alias("thread_root"), "depth")
        further = up.join(above, ["conv_id", "up"], "left")
        up = common.stored(further.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "threads")


def positions(keyed: DataFrame) -> DataFrame:
    """(k1, k2, position) of rows (conv_id, thread_root, turn, k1, k2): their place in reply order.

    Rows are dealt by ranges of that order; a row's place is its place in its range after the rows
    of its conversation in the ranges before, of which there are as many as partitions at most."""
    order = ["conv_id", "thread_root", "turn", "k1", "k2"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = common.stored(dealt.select("conv_id", "k1", "k2", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "order")
    spans = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (before - F.col("lo")).alias("shift"))
    placed = dealt.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return placed.groupBy("k1", "k2").agg(F.min(F.col("at") + F.col("shift")).alias("position"))


def format_chat(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text, ...) with content, n_quoted, n_linked, parent_turn,
    thread_root, depth and position, dealt and sorted by (conv_id, thread_root, turn): reply order."""
    k1, k2 = common.row_keys("conv_id", "turn", "role", "text")
    kept = [c for c in messages.columns if c.lower() not in MADE]
    rows = messages.select(*common.others(messages, *MADE), k1.alias("__k1"), k2.alias("__k2"), parsed(F.col("text")).alias("__lines"))
    quoted = F.size(F.filter("__lines", lambda x: (x.level > 0) & (x.norm != ""))).cast("long")
    content = content_of(F.col("__lines"))
    content = F.when(F.col("text").isNull() | (content != F.col("text")), content)  # null where it is the text itself
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "__k1", "__k2", content.alias("__content"), quoted.alias("n_quoted"), passages(F.col("__lines")).alias("__passages"))
    rows = common.stored(rows, "parsed")
    found = common.stored(links(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__passages").alias("passages"))), "links")
    out = rows.drop("__passages").withColumn("content", F.coalesce("__content", "text"))
    if found.isEmpty():
        threads = rows.select("conv_id", F.col("turn").alias("thread_root"), "turn", F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("parent_turn"), F.lit(0).cast("long").alias("depth"))
    else:
        by_row = found.select("k1", "k2", "n_linked", "parent_turn").distinct()
        threads = rows.select("conv_id", "turn", F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).join(by_row, ["k1", "k2"], "left").join(roots(found), ["conv_id", "turn"], "left")
        threads = threads.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread_root": F.coalesce("thread_root", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")})
    threads = common.stored(threads, "threads-of-rows")
    facts = threads.select("k1", "k2", "n_linked", "parent_turn", "thread_root", "depth").distinct().join(positions(threads.select("conv_id", "thread_root", "turn", "k1", "k2")), ["k1", "k2"])
    out = out.join(facts.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in kept], *MADE)
    return out.repartitionByRange("conv_id", "thread_root", "turn").sortWithinPartitions("conv_id", "thread_root", "turn")


def digest(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "content", "n_quoted", "n_linked", "parent_turn", "thread_root", "depth", "position")
