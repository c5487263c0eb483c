"""Source divergence audit (operator 12): how far the sources of a language differ in their words.

Terms are counted for each (lang, source) group. A language keeps the V terms that at least `least` of its
documents have. A group gives a kept term of count c the weight p = 1 + floor(10^9 (c + 5) / (N + 5 V)),
N being its count of all kept terms. Two sources differ by the sum of |p - p'| over all kept terms. That
sum is split by how many groups have a term:

* a group gives the same weight z to all terms that it hasn't, so the sum is V |z - z'|, corrected term by term;
* heavy terms, which at least a quarter of the language's sources have or more than LIGHT of them, are laid
  out as dense tiles of groups by terms, and pairs of groups are compared row by row;
* light terms are corrected for each that one of the two has, which only needs the group's weights and how
  often it gives each, and again for those that both have, pair by pair of a posting list of at most LIGHT groups.

All numbers are 64-bit integers and the parts add up exactly. Tiles have at most 2 * GROUPS groups and
about TERMS terms. Each task adds up its pairs before they are shuffled.

Defined results: null text, lang and source are ''; repeated rows are documents of their own; groups
without a term give every kept term the count 0, and without kept terms (V = 0) all values are 0; a
language of one source has no `pair` rows; an empty table gives an empty result; columns besides text,
lang and source are not read. Counts up to 9 * 10^15 are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.llm import common, words

#: The documents that a kept term has, what is added to each count, the unit of weights, and ranks of terms.
LEAST, PLUS, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Not of a term: all ASCII but letters.
APART = words.table_of(b for b in range(0x80) if not chr(b).isalpha())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Most groups of a light term, terms in a tile, groups in a block of a tile, terms in a part of light ones, and bytes counted at once.
LIGHT, TERMS, GROUPS, PART, SLICE = 32, 64, 256, 2048, 4 << 20


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of rows (text, lang, source); each group has a row with a null term too."""
    coded, per_text = words.words(batch.column(0), APART, LOWER)
    pairs = pa.table({"lang": batch.column(1), "source": batch.column(2), "k": np.arange(batch.num_rows)}).group_by(["lang", "source"]).aggregate([("k", "list")])
    group = np.empty(batch.num_rows, np.int64)
    lists = pairs.column("k_list").combine_chunks()
    group[lists.flatten().to_numpy()] = np.repeat(np.arange(len(pairs)), np.diff(lists.offsets.to_numpy()))
    size = max(1, len(coded.dictionary))
    keys = np.repeat(np.arange(batch.num_rows), per_text) * size + coded.indices.to_numpy(zero_copy_only=False)
    keys, times = np.unique(keys, return_counts=True)  # a text and one of its terms
    keys, at = np.unique(group[keys // size] * size + keys % size, return_inverse=True)
    n, docs = np.bincount(at, times, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
    named = pa.concat_arrays([pa.array(keys // size), pa.array(np.arange(len(pairs)))])
    zeros = np.zeros(len(pairs), np.int64)
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(keys % size)).cast(pa.binary()), pa.nulls(len(pairs), pa.binary())])
    cols = [pairs.column("lang").combine_chunks().take(named), pairs.column("source").combine_chunks().take(named), terms, pa.array(np.append(n, zeros)), pa.array(np.append(docs, zeros))]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each."""

    size = SLICE

    def run(batches):
        for whole in batches:
            whole = pa.RecordBatch.from_arrays([whole.column(0).cast(pa.large_binary()), whole.column(1), whole.column(2)], names=["text", "lang", "source"])
            for batch in words.slices(whole, 0, size):
                yield counted(batch)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    found = docs.select(F.col(text_col).cast("binary").alias("text"), *named).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(c: Column, total: Column) -> Column:
    """floor(UNIT * c / total) for c <= total, by long division in base 1000, so that no step leaves 64 bits."""
    whole, rest = F.lit(0).cast("long"), c
    for _ in range(3):
        rest = rest * F.lit(1000)
        whole, rest = whole * F.lit(1000) + F.call_function("div", rest, total), rest % total
    return whole


def weight(n: Column, total: Column, kept: Column) -> Column:
    """The weight of a term of count n in a group with `total` occurrences of `kept` terms."""
    return F.lit(1) + share(n + F.lit(PLUS), total + kept * F.lit(PLUS))


def tables(docs: DataFrame, least: int = LEAST, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(groups, postings), stored: (lang, source, gid, total, kept, heavy, light, zero), gid numbering the sources of
    a language from 0 by name, and (lang, source, gid, term, n, df, p, q, m): weights in the group and in its
    language, and how many groups have the term."""
    every = common.stored(counts(docs, **columns), "counts")
    by_term = Window.partitionBy("lang", "term")
    kept = every.where("term IS NOT NULL").withColumns({"df": F.sum("docs").over(by_term), "m": F.count("*").over(by_term), "all": F.sum("n").over(by_term)}).where(F.col("df") >= least)
    kept = common.stored(kept.drop("docs"), "kept")
    sources = every.where("term IS NULL").select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("gid"))
    n_sources = sources.groupBy("lang").agg(F.count("*").alias("n_sources"))
    terms = kept.groupBy("lang", "term").agg(F.first("m").alias("m"), F.first("all").alias("all")).join(F.broadcast(n_sources) if common.fits_broadcast(n_sources) else n_sources, "lang")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.count_if(heavy()).alias("heavy"), F.sum("all").alias("lang_total"))
    groups = sources.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(n_sources, "lang").join(of_lang, "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "kept", "heavy", "lang_total")}).withColumn("light", F.col("kept") - F.col("heavy"))
    groups = common.stored(groups.withColumn("zero", F.when(F.col("kept") > 0, weight(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long"))), "groups")
    named = kept.join(common.sized(groups), ["lang", "source"])
    weights = {"p": weight(F.col("n"), F.col("total"), F.col("kept")), "q": weight(F.col("all"), F.col("lang_total"), F.col("kept")), "is_heavy": heavy()}
    postings = named.withColumns(weights).select("lang", "source", "gid", "term", "n", "df", "p", "q", "m", "is_heavy", "heavy", "light", "zero")
    return groups, common.stored(postings, "postings")


def heavy() -> Column:
    return (F.col("m") * 4 >= F.col("n_sources")) | (F.col("m") > LIGHT)


PAIR = "lang string, a int, b int, part long"


def summed(a: np.ndarray, b: np.ndarray, part: np.ndarray, lang: str) -> pd.DataFrame:
    """Parts added up by pair."""
    width = int(b.max(initial=0)) + 1
    keys, at = np.unique(a.astype(np.int64) * width + b, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, part)
    return pd.DataFrame({"lang": lang, "a": (keys // width).astype(np.int32), "b": (keys % width).astype(np.int32), "part": total})


def dense(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, part), a < b: what heavy terms add to |z - z'| each, by tiles of a block of terms and two blocks
    of groups; a term that no group of a tile has adds nothing."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("gid") / GROUPS) + 1).cast("int").alias("blocks"))
    size, block = GROUPS, F.floor(F.col("gid") / GROUPS).cast("int")
    tile = F.pmod(F.xxhash64("term"), F.ceil(F.col("heavy") / TERMS))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("x"), F.greatest(x, block).alias("y")))
    given = postings.where("is_heavy").join(common.sized(blocks), "lang").select("lang", "gid", "term", "p", tile.alias("tile"), F.explode(pairs).alias("at"))
    # groups that have none of a tile's terms count too: each tile gets the weight z of all groups of its blocks
    zeros = groups.where("heavy > 0").join(common.sized(blocks), "lang").select("lang", "gid", F.lit(None).cast("binary").alias("term"), F.col("zero").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("heavy") / TERMS) - 1)).alias("tile"), F.explode(pairs).alias("at"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, x, y = key
        empty = rows["term"].isna().to_numpy()
        zero = rows[empty].sort_values("gid")
        gids = zero["gid"].to_numpy()
        code, terms = pd.factorize(rows["term"][~empty])
        base = zero["p"].to_numpy(np.int64)
        grid = np.repeat(base[:, None], max(1, len(terms)), 1)
        grid[np.searchsorted(gids, rows["gid"].to_numpy()[~empty]), code] = rows["p"].to_numpy(np.int64)[~empty]
        if not len(terms):
            return pd.DataFrame({"lang": [], "a": [], "b": [], "part": []}).astype({"lang": str, "a": "int32", "b": "int32", "part": "int64"})
        of_y, out = gids // size == y, []
        for k in np.flatnonzero(gids // size == x):
            other = np.flatnonzero(of_y & (gids > gids[k]))
            out.append(pd.DataFrame({"lang": lang, "a": np.int32(gids[k]), "b": gids[other].astype(np.int32), "part": np.abs(grid[other] - grid[k]).sum(axis=1) - len(terms) * np.abs(base[other] - base[k])}))
        return pd.concat(out)

    both = given.unionByName(zeros).select("lang", "tile", "at.x", "at.y", "gid", "term", "p")
    return both.groupBy("lang", "tile", "x", "y").applyInPandas(run, PAIR)


def both_have(postings: DataFrame) -> DataFrame:
    """(lang, a, b, part), a < b: corrections for the light terms that both groups have."""
    part, most = F.pmod(F.xxhash64("term"), F.ceil(F.col("light") / PART)), LIGHT

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        code, _ = pd.factorize(rows["term"])
        by = np.lexsort((rows["gid"].to_numpy(), code))
        code, gid, p, z = code[by], *[rows[c].to_numpy()[by] for c in ("gid", "p", "zero")]
        found = []
        for k in range(1, most):
            a = np.flatnonzero(code[k:] == code[:-k]) if k < len(code) else np.zeros(0, int)
            if not len(a):
                break
            b = a + k
            found.append((gid[a], gid[b], np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(z[a] - p[b]) + np.abs(z[a] - z[b])))
        a, b, more = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        return summed(a, b, more, key[0])

    light = postings.where("NOT is_heavy").select("lang", "gid", "term", "p", "zero", part.alias("part"))
    return light.groupBy("lang", "part").applyInPandas(run, PAIR)


def one_has(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, part) of all pairs a < b: V |z - z'|, and corrections for the light terms of either group as if
    the other had none of them. A group's light weights are few different numbers, each with its count."""
    size = GROUPS
    given = postings.where("NOT is_heavy").groupBy("lang", "gid", "p").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("gid") / GROUPS))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("gid") / GROUPS).alias("blocks"))
    others = groups.join(common.sized(blocks), "lang").select("lang", "gid", "zero", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("block"))

    def run(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        lang, block = key
        theirs = theirs.sort_values("gid")
        gids, zero, kept = (theirs[c].to_numpy(np.int64) for c in ("gid", "zero", "kept"))
        own = {g: rows.sort_values("p") for g, rows in mine.groupby("gid")}
        out = []
        for k in np.flatnonzero(gids // size == block):
            g, z = gids[k], zero[k]
            part = np.where(gids > g, kept[k] * np.abs(z - zero), 0)
            if g in own:
                p, n = own[g]["p"].to_numpy(np.int64), own[g]["n"].to_numpy(np.int64)
                below, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
                at = np.searchsorted(p, zero)
                # sum of n |p - zero|: those below, then those above
                off = zero * below[at] - total[at] + total[-1] - total[at] - zero * (below[-1] - below[at])
                part = part + off - below[-1] * np.abs(z - zero)
            keep = gids != g
            a, b = np.minimum(gids, g)[keep], np.maximum(gids, g)[keep]
            out.append(pd.DataFrame({"lang": lang, "a": a.astype(np.int32), "b": b.astype(np.int32), "part": part[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "part": []}).astype({"lang": str, "a": "int32", "b": "int32", "part": "int64"})

    return given.groupBy("lang", "block").cogroup(others.groupBy("lang", "block")).applyInPandas(run, PAIR)


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, value): how far each two sources of a language differ; a < b number its sources."""
    parts = dense(postings, groups).unionByName(both_have(postings)).unionByName(one_has(postings, groups))
    return parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: each other source of the language and how far it
    differs. Part `term`: the `top` terms that the group has and uses more than its language, and by how much."""
    groups, postings = tables(docs, least, **columns)
    found = pairs(groups, postings)
    sides = F.inline(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other"))))
    names = common.sized(groups.select("lang", "gid", "source"))
    both = found.select("lang", "value", sides).join(names, ["lang", "gid"]).join(names.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = postings.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked.unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
seen AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM seen GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, term, count(*) AS c FROM seen JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, sum(coalesce(n.c, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (total::HUGEINT + 5 * v) AS p FROM dense JOIN v USING (lang)),
lc AS (SELECT lang, term, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS total FROM n GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (total::HUGEINT + 5 * v) AS q FROM lc JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every) WHERE part = 'pair' OR rank <= 50
"""
