"""Operator 12: sums split into heavy and light terms against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

from orolith.llm import divergence
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top=50):
    """The result from rows (text, lang, source), by adding up every kept term for every pair."""
    counts, df, langs = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        terms, lang, source = TERM.findall(lowered(text or "")), lang or "", source or ""
        langs[lang].add(source)
        counts[lang, source].update(terms)
        df.update({(lang, t) for t in terms})
    out = []
    for lang, sources in langs.items():
        kept = {t for (g, t), n in df.items() if g == lang and n >= least}
        v = len(kept)
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}
        p = {s: weigh(counts[lang, s]) for s in sources}
        q = weigh(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audited(spark, rows, least, top=50):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "text string, lang string, source string, term string, n int")
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(docs, least, top).collect())


def made(n_sources, n, seed):
    rnd = random.Random(seed)
    rare = [f"r{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = []
    for k in range(n):
        source = f"s{rnd.randrange(n_sources)}"
        text = " ".join(rnd.choices(["The", "OF", "and", "Übung", "ÉTÉ", "x_y", "a1b"], k=rnd.randint(0, 12)) + rnd.choices(rare[int(source[1:]) % 50 :], k=rnd.randint(0, 9)))
        rows.append((text if k % 17 else None, rnd.choice(["en", "de", None, ""]), source if k % 13 else None))
    return rows


def test_heavy_and_light_terms_add_up(spark):
    rows = made(60, 700, 1)
    assert audited(spark, rows, 3) == plain(rows, 3)


def test_several_blocks_of_groups_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 4)
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "LIGHT", 3)
    monkeypatch.setattr(divergence, "PART", 5)
    monkeypatch.setattr(divergence, "SLICE", 50)
    rows = made(11, 300, 2)
    assert audited(spark, rows, 2, 4) == plain(rows, 2, 4)


def test_without_kept_terms_all_values_are_zero(spark):
    rows = [("a b", "en", "s"), (None, "en", "t"), ("", "en", None), ("1 2 _", None, "s"), ("a b", "en", "s")]
    got = audited(spark, rows, 30)
    assert got == plain(rows, 30) and len(got) == 6 and {r[4] for r in got} == {0}
    assert audited(spark, rows, 1) == plain(rows, 1)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_equal_values_are_ranked_by_bytes(spark):
    rows = [("Zz é b \U0001f600 ￮", "en", "A"), ("q", "en", "é"), ("q", "en", "z")]
    got = audited(spark, rows, 1)
    assert got == plain(rows, 1)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "A" and r[2] == "term"] == ["b", "zz", "é", "￮", "\U0001f600"]


def test_long_division_is_exact(spark):
    big = 9_000_000_000_000_000
    rows = [(1, 3), (big - 1, big), (123_456_789_012_345, 999_999_999_999_999), (7, 7)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [10**9 * c // t for c, t in rows]
