"""Personal data by bootstrapped contextual extraction (operator 11), in DataFrame functions alone.

Seeds are the base spans: e-mail addresses, IP addresses, card numbers that pass Luhn's check, and phone
numbers. Candidates are what looks like an identifier but is no seed: groups of 7 to 19 digits and words
with an @ in them, that overlap no seed. Each has up to three lexical patterns: the word before it, the two words
before it, and the word behind it (lower-cased, between white space). Patterns and values form a graph:

* a pattern's confidence for a kind is the share of its occurrences in the whole corpus that stand beside
  known values of the kind, each weighed by its own confidence. It counts if at least SUPPORT different
  values are known there and the confidence is PATTERN or more. So common words, which mostly stand
  elsewhere, never count.
* a value's confidence is 1 - product of (1 - pattern's confidence) over its patterns that count. From ADOPT on
  the value is known, in the next round too, and takes part in the patterns' confidence; seeds have 1.

Rounds go on until no value is new, ROUNDS at most. Known candidates give spans of their kind (of the best
confidence; of equal ones the first as listed).

Patterns for matching have no group that is repeated by backtracking, and none begins within a run that it
cannot match from its start, so any text is read in time in proportion to its length.

Texts are read twice: once for seeds and candidates, once to count the patterns' words. Equal texts are worked on once, named by 128 bits;
what is shuffled are spans, values and patterns. A text's spans lie in one task.

Defined results: null and empty texts have no spans; texts are read whole; bytes that are no UTF-8 are
replacement characters; spans are counted in code points, end exclusive; spans of different kinds may overlap;
null ids and repeated rows are rows like any other; an empty table gives an empty result; columns besides
id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.functions.geo import let
from orolith.llm import common

#: Kinds in order and their patterns. A pattern begins where a match ended (\G) or where no character of its own kind stands before.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Candidates: groups of digits that no letter touches, and words around an @.
NUMBER = r"(?<![A-Za-z0-9])[0-9][0-9\x20().:/-]*[0-9](?![A-Za-z0-9])"
HANDLE = r"(?<![^\s@])[^\s@]++@[^\s@]++"
MARKS = [EMAIL, IP, CARD, PHONE, NUMBER, HANDLE]
#: What a text must have for a pattern to match at all.
HINTS = ["@", None, None, "+", None, "@"]
#: Characters kept before and behind a match for its context.
BEFORE, BEHIND = 96, 48
#: Parameters: different known values of a pattern, least confidence of patterns and of values, and rounds.
SUPPORT, PATTERN, ADOPT, ROUNDS = 3, 0.6, 0.8, 5


def marks(text: Column) -> Column:
    """An array of (mark, k, before, size, value, left, right): the k-th match of each of MARKS, the characters
    between it and the match before, its size and what stands around it."""
    found = []
    for n, (pattern, hint) in enumerate(zip(MARKS, HINTS, strict=True)):
        here = F.contains(text, F.lit(hint)) if hint else text.rlike(r"[0-9][\x20().:/-]?[0-9]")
        gaps = F.when(here, F.split(text, pattern, -1)).otherwise(F.array(F.lit("")))
        matches = F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

        found.append(let(F.struct(F.lit(n).alias("mark"), gaps.alias("gaps"), matches.alias("matches")), marked))
    return F.concat(*found)


def marked(found: Column) -> Column:
    """The marks of a struct (mark, gaps, matches); there is a gap before each match and one behind the last."""
    def one(match, k):
        left, right = F.get(found["gaps"], k), F.get(found["gaps"], k + 1)
        return F.struct(
            found["mark"].alias("mark"), k.alias("k"), F.length(left).alias("before"), F.length(match).alias("size"), match.alias("value"),
            F.right(left, F.lit(BEFORE)).alias("left"), F.left(right, F.lit(BEHIND)).alias("right"),
        )

    return F.transform(found["matches"], one)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(total, k):
        x = F.substr(number, F.length(number) - k + 1, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def is_base(mark: Column, value: Column) -> Column:
    """Whether a match of the first four patterns is personal data."""
    number = digits(value)
    n = F.length(number)
    rules = F.when(mark == 0, F.lit(True)).when(mark == 1, value.rlike("^" + r"\.".join([OCTET] * 4) + "$"))
    return rules.when(mark == 2, n.between(13, 19) & luhn(F.left(number, F.lit(19)))).when(mark == 3, n.between(9, 15)).otherwise(F.lit(False))


def possible(mark: Column, value: Column) -> Column:
    """The kinds that a candidate may be of."""
    n = F.length(digits(value))
    number = F.when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.array(F.lit(1)))
    number = number.when(~n.between(7, 19), F.array().cast("array<int>")).when(n < 12, F.array(F.lit(3))).when(n < 16, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))
    return F.when(mark == 4, number).when(mark == 5, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def spans_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, copies, kind, start, end, value, left, right, kinds) of rows (k1, k2, marks): base spans have a kind, candidates
    the kinds that they may be of. A row for each different text's span; copies counts the texts."""
    texts = rows.where(F.size("marks") > 0).groupBy("k1", "k2").agg(F.first("marks").alias("marks"), F.count("*").alias("copies"))
    each = texts.select("k1", "k2", "copies", F.inline("marks"))
    before = Window.partitionBy("k1", "k2", "mark").orderBy("k")
    end = F.sum(F.col("before").cast("long") + F.col("size")).over(before)
    each = each.withColumns({"end": end}).withColumn("start", F.col("end") - F.col("size"))
    mark, value = F.col("mark"), F.col("value")
    each = each.withColumns({"kind": F.when(is_base(mark, value), mark), "kinds": possible(mark, value)}).where("kind IS NOT NULL OR size(kinds) > 0")
    upto, onwards = Window.partitionBy("k1", "k2").orderBy("start"), Window.partitionBy("k1", "k2").orderBy(F.desc("start"))
    base = F.col("kind").isNotNull()
    each = each.withColumns({"__end": F.max(F.when(base, F.col("end"))).over(upto), "__next": F.min(F.when(base, F.col("start"))).over(onwards)})
    free = (F.coalesce("__end", F.lit(0)) <= F.col("start")) & (F.coalesce("__next", F.col("end")) >= F.col("end"))
    return each.where(base | free).select("k1", "k2", "copies", "kind", "start", "end", "value", "left", "right", "kinds")


def contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of what stands between left and right."""
    before = F.when(left.rlike(r"\s$"), F.filter(F.split(F.lower(left), r"\s+"), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    behind = F.when(right.rlike(r"^\s+\S"), F.filter(F.split(F.lower(right), r"\s+"), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    n = F.size(before)
    pattern = lambda form, text, there: F.when(there, F.named_struct(F.lit("form"), F.lit(form), F.lit("words"), text))
    made = F.array(pattern("before", F.get(before, n - 1), n > 0), pattern("two before", F.concat_ws(" ", F.get(before, n - 2), F.get(before, n - 1)), n > 1), pattern("behind", F.get(behind, F.lit(0)), F.size(behind) > 0))
    return F.filter(made, lambda p: p.isNotNull())


def occurrences(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(words, occurs): how often words of `wanted` (words: one or two) stand in all texts."""
    plain = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != "")
    each = docs.select(plain.alias("w")).select(F.explode(F.concat("w", F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x)))).alias("words"))
    if common.fits_broadcast(wanted):
        return each.join(F.broadcast(wanted), "words", "left_semi").groupBy("words").agg(F.count("*").alias("occurs"))
    return each.groupBy("words").agg(F.count("*").alias("occurs")).join(wanted, "words", "left_semi")


def discovered(edges: DataFrame, occurs: DataFrame, support: int = SUPPORT, pattern: float = PATTERN, adopt: float = ADOPT, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, score) of candidates that become known; edges: (kind, value, seed, form, words, weight)."""
    edges = common.stored(edges.join(common.sized(occurs), "words"), "edges")
    known, before = None, 0
    for _ in range(rounds):
        told = edges.withColumn("score", F.when(F.col("seed"), F.lit(1.0)))
        if known is not None:
            told = told.join(common.sized(known.withColumnRenamed("score", "__score")), ["kind", "value"], "left").withColumn("score", F.coalesce("score", "__score"))
        rated = told.where("score IS NOT NULL").groupBy("kind", "form", "words", "occurs").agg(F.count_distinct("value").alias("n"), F.sum(F.col("score") * F.col("weight")).alias("hits"))
        share = F.least(F.lit(1.0), F.col("hits") / F.col("occurs"))
        rated = common.stored(rated.where(F.col("n") >= support).withColumn("share", share).where(F.col("share") >= pattern).select("kind", "form", "words", "share"), "patterns")
        met = edges.where("NOT seed").join(common.sized(rated), ["kind", "form", "words"])
        missed = F.array_sort(F.collect_list(1 - F.col("share")))  # three patterns for each place; equal ones once
        per_value = met.select("kind", "value", "form", "words", "share").distinct().groupBy("kind", "value").agg(missed.alias("l"))
        score = 1 - F.aggregate(F.slice("l", 1, 64), F.lit(1.0), lambda a, x: a * x)  # sorted: the surest 64; more change nothing
        known = common.stored(per_value.select("kind", "value", score.alias("score")).where(F.col("score") >= adopt), "known")
        now = known.count()
        if now == before:
            break
        before = now
    return known


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for each row of docs: counts and hash of
    the base spans, all spans, and the number of those that the method added."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = common.row_keys(text)
    rows = common.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), marks(text).alias("marks")), "marks")
    spans = common.stored(spans_of(rows), "spans")
    seed = F.col("kind").isNotNull()
    value = F.when(F.array_contains("kinds", 0) | (F.col("kind") == 0), F.lower("value")).otherwise(F.regexp_replace("value", r"[\x20()-]", ""))
    each = spans.select(F.explode(F.when(seed, F.array("kind")).otherwise(F.col("kinds"))).alias("kind"), value.alias("value"), seed.alias("seed"), F.col("copies"), F.explode(contexts(F.col("left"), F.col("right"))).alias("p"))
    edges = common.stored(each.groupBy("kind", "value", "seed", "p.form", "p.words").agg(F.sum("copies").alias("weight")), "graph")
    least = int(parameters.get("support", SUPPORT))
    wanted = edges.groupBy("kind", "form", "words").agg(F.count_distinct("value").alias("n"), F.count_if(~F.col("seed")).alias("open")).where(F.col("n") >= least)
    wanted = common.stored(wanted.select("words").distinct(), "wanted")
    if edges.where("NOT seed").isEmpty():
        found = spans.select("k1", "k2", "kind", "start", "end", F.lit(False).alias("added"))
    else:
        occurs = common.stored(occurrences(docs, wanted, text_col), "occurrences")
        known = discovered(edges, occurs, **parameters)
        added = spans.where("kind IS NULL").withColumn("value", value).select("k1", "k2", "start", "end", "value", F.explode("kinds").alias("kind")).join(common.sized(known), ["kind", "value"])
        best = F.min(F.struct((-F.col("score")).alias("s"), F.col("kind")))["kind"]
        added = added.groupBy("k1", "k2", "start", "end").agg(best.alias("kind"))
        found = spans.where(seed).select("k1", "k2", "kind", "start", "end", F.lit(False).alias("added")).unionByName(added.select("k1", "k2", "kind", "start", "end", F.lit(True).alias("added")))
    listed = lambda items: F.array_join(F.transform(F.array_sort(items), lambda s: F.concat(F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    span = F.struct("kind", "start", "end")
    counts = {f"n_{k}": F.count_if(~F.col("added") & (F.col("kind") == n)) for n, k in enumerate(KINDS)}
    per_text = found.groupBy("k1", "k2").agg(*[c.alias(n) for n, c in counts.items()], F.collect_list(F.when(~F.col("added"), span)).alias("base"), F.collect_list(span).alias("every"), F.count_if("added").alias("n_found"))
    per_text = common.stored(per_text.select("k1", "k2", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), "n_found"), "per-text")
    out = rows.select("doc_id", "k1", "k2").join(common.sized(per_text), ["k1", "k2"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
