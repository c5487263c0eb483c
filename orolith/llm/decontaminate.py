"""Benchmark decontamination by spaced seeds (operator 6), in DataFrame functions alone.

Tokens are runs of letters and digits, lower-cased. Each fixed mask below looks at SPAN tokens and
hashes those marked 1; so a window still meets its benchmark twin if the tokens marked 0 differ.
Window hashes of documents are joined with those of benchmark items. Around each hit the item is
laid over the document on the hit's diagonal: a matching token scores 1, another one -4, and the
best stretch counts its matching tokens. An item is leaked if these are at least `overlap` tokens
or 80 % of the item (SPAN tokens at least), whichever is less. An item shorter than SPAN tokens is a window by itself, and is
leaked where it stands verbatim.

Defined results: null and empty texts match nothing, nor do items without a token; repeated documents
or items give one row a pair; null ids are ids like any other; empty tables give an empty result;
columns besides id and text are not read by `leaks`, and all are kept by `drop_leaked`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orolith.llm import common

#: Token positions that count, as spaced seeds of weight 7.
MASKS = ["1101100111", "1110010111", "1011110011"]
SPAN = len(MASKS[0])
#: Tokens in a piece of a text whose windows are made together, and parts that a window's copies are dealt in.
CHUNK, SALTS = 256, 16
OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_keys(tokens: Column, at: Column) -> list[Column]:
    """The hash of the window at `at` under each mask."""
    return [F.xxhash64(F.lit(m), *[F.get(tokens, at + o) for o in offsets]) for m, offsets in enumerate(OFFSETS)]


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, j, key): all windows of items (item_id, itok); an item shorter than a window is one by itself."""
    n, tokens = F.size("itok"), F.col("itok")
    at = items.select("item_id", "itok", F.explode(F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)))).alias("j"))
    keys = F.when(n >= SPAN, F.array(*seed_keys(tokens, F.col("j")))).otherwise(F.array(F.xxhash64(-n, tokens)))
    return at.select("item_id", "j", F.explode(keys).alias("key"))


def told(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(k1, k2, p, key): all windows of texts (k1, k2, tok), and those of the lengths that short items have.

    A text is first cut into chunks that overlap by a window, so that no window's row carries more
    than CHUNK + SPAN tokens on its way, however long the text is."""
    n = F.size("tok")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), lambda c: F.struct(c.alias("c"), F.slice("tok", c + 1, CHUNK + SPAN - 1).alias("w")))
    chunks = texts.where(n > 0).select("k1", "k2", F.explode(cut).alias("x")).select("k1", "k2", "x.c", "x.w")
    rows = chunks.select("k1", "k2", "c", "w", F.explode(F.sequence(F.lit(0), F.least(F.size("w"), F.lit(CHUNK)) - 1)).alias("p"))
    w, p = F.col("w"), F.col("p")
    keys = [F.when(p + SPAN <= F.size(w), k) for k in seed_keys(w, p)]
    keys += [F.when(p + m <= F.size(w), F.xxhash64(F.lit(-m), F.slice(w, p + 1, m))) for m in lengths]
    return rows.select("k1", "k2", (F.col("c") + p).alias("p"), F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """Struct (first, last, matched) of the best stretch of item tokens, with item token k over
    document token k + shift."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "since", "same", "best", "first", "last", "matched")])

    def step(s, k):
        same = F.coalesce(F.get(item, k) == F.get(doc, k + shift), F.lit(False))
        fresh = s.score <= 0
        score = F.when(fresh, 0).otherwise(s.score) + F.when(same, 1).otherwise(-4)
        since, count = F.when(fresh, k).otherwise(s.since), F.when(fresh, 0).otherwise(s.same) + F.when(same, 1).otherwise(0)
        better = score > s.best
        return F.struct(
            score.alias("score"), since.alias("since"), count.alias("same"), F.when(better, score).otherwise(s.best).alias("best"),
            F.when(better, since).otherwise(s["first"]).alias("first"), F.when(better, k).otherwise(s["last"]).alias("last"), F.when(better, count).otherwise(s.matched).alias("matched"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), zero, step)


def leaked_texts(texts: DataFrame, benchmark: DataFrame, overlap: int = 25, item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """(k1, k2, item_id, matched, item_tokens, first, last) of texts (k1, k2, text), a row for each
    leaked item of a different text; first and last count tokens of it.

    The seeds of a benchmark with at most broadcast_rows windows are broadcast; those of a larger one
    are joined by shuffling window hashes, each in SALTS parts so that no window's copies meet in one
    task. A hit is a diagonal of a text and an item, once; tokens meet again only for those.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("itok")).where(F.size("itok") > 0)
    items = common.stored(items.distinct().select("item_id", "itok", F.xxhash64("item_id", "itok").alias("nr")), "items")
    seeds = common.stored(item_seeds(items.select(F.col("nr").alias("item_id"), "itok")).withColumnRenamed("item_id", "nr"), "seeds")
    lengths = [r.n for r in items.where(F.size("itok") < SPAN).select(F.size("itok").alias("n")).distinct().orderBy("n").collect()]  # fewer than SPAN
    windows = told(texts.select("k1", "k2", token_hashes(F.col("text")).alias("tok")), lengths)
    if common.fits_broadcast(seeds, broadcast_rows):
        met = windows.join(F.broadcast(seeds), "key")
    else:
        parts = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = windows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(parts, ["key", "salt"])
    hits = common.stored(met.groupBy("k1", "k2", "nr", (F.col("p") - F.col("j")).alias("shift")).agg(F.count("*").alias("n")).drop("n"), "hits")

    found = texts.join(common.sized(hits.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    found = found.select("k1", "k2", token_hashes(F.col("text")).alias("tok"))
    laid = found.join(hits, ["k1", "k2"]).join(common.sized(items), "nr")
    best = best_stretch(F.col("tok"), F.col("itok"), F.col("shift"))
    laid = laid.select("k1", "k2", "item_id", F.size("itok").alias("item_tokens"), "shift", best.alias("b"))
    start, end = F.col("b.first") + F.col("shift"), F.col("b.last") + F.col("shift")
    top = F.max(F.struct(F.col("b.matched").alias("matched"), (-start).alias("start"), (-end).alias("end")))
    n = F.col("item_tokens")
    enough = F.when(n < SPAN, n).otherwise(F.least(F.lit(overlap), F.greatest(F.lit(SPAN), F.ceil(n * F.lit(0.8)))))
    out = laid.groupBy("k1", "k2", "item_id", "item_tokens").agg(top.alias("t")).where(F.col("t.matched") >= enough)
    numbers = {"matched": F.col("t.matched"), "item_tokens": n, "first": -F.col("t.start"), "last": -F.col("t.end")}
    return out.select("k1", "k2", "item_id", *[c.cast("long").alias(name) for name, c in numbers.items()])


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = 25, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, first, last, k1, k2), a row for each leaked item;
    k1 and k2 name the document's text."""
    k1, k2 = common.row_keys(F.col(text_col))
    docs = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    found = common.stored(leaked_texts(docs.drop("doc_id"), benchmark, overlap, item_id, item_text, broadcast_rows), "leaked")
    named = docs.select("doc_id", "k1", "k2").join(common.sized(found), ["k1", "k2"])
    return named.select("doc_id", "item_id", "matched", "item_tokens", "first", "last", "k1", "k2").distinct()


def drop_leaked(docs: DataFrame, benchmark: DataFrame, overlap: int = 25, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no benchmark item; columns stay."""
    k1, k2 = common.row_keys(F.col(text_col))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    bad = common.stored(leaked_texts(texts, benchmark, overlap).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct(), "leaked")
    named = docs.withColumns({"__k1": k1, "__k2": k2}).join(common.sized(bad), ["__k1", "__k2"], "left_anti")
    return named.select(*common.others(docs))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "item_id", "matched", "item_tokens", "first", "last").distinct()
