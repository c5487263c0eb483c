"""Each operator on small frames: nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns whose names clash with those an operator makes."""

import base64
import gzip
import math
import urllib.parse

import duckdb
import numpy as np
import pytest

from orolith.llm import chat_format, common, decontaminate, exact_topk, language_id, line_dedup, mixing, quality, secret_scan, simhash, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", k1 string, n string, fp string, src string, tok string, lang_pred int, score string, copy string, n_lines string, kept_text string, item_id string, target string, key string, root string, p string"
EXTRA = ("x",) * 5 + (1,) + ("x",) * 9


def frame(spark, texts, langs=None, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS + CLASH).repartition(3)


LONG = "lorem ipsum dolor " * 40_000
ODD = [None, "", " ", "\n\n", "a\nA \nb", "a \nx", "a\nA \nb", LONG, "é\r\na", "퟿𝄞 z"]


# line dedup


def brute_lines(texts, least):
    seen = {}
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER)) for line in (t or "").split("\n")] for t in texts]
    for ks in keys:
        for k in set(ks) - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [line for line, k in zip((t or "").split("\n"), ks, strict=True) if seen.get(k, 0) < least]
        out.append((len(ks), len(ks) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    texts = ODD + [f"only {k}\nshared  line\n\tA" for k in range(12)]
    got = line_dedup.dedup_lines(frame(spark, texts), min_docs=3, batches=batches, fanout=fanout)
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()}
    assert [rows[k] for k in range(len(texts))] == brute_lines(texts, 3)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.columns.count("n_lines") == 1


def test_line_dedup_repeated_rows_and_ids(spark):
    docs = frame(spark, ["x\ny"] * 3 + ["z"], ids=[1, 1, None, 2])
    rows = line_dedup.dedup_lines(docs, min_docs=3).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in rows) == [(0, ""), (1, ""), (1, ""), (2, "z")]


def test_line_runs_are_levelled(spark):
    index = line_dedup.LineRuns(spark, 5, 2)
    for batch in range(4):
        index.add(spark.createDataFrame([(k, k) for k in range(batch, batch + 3)], "h1 long, h2 long"))
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert {(r.h1, r.n) for r in index.runs()[0].collect()} == {(0, 1), (1, 2), (2, 3), (3, 3), (4, 2), (5, 1)}


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.digest(line_dedup.dedup_lines(docs)).count() == 0
    assert quality.from_labels(docs, labels).count() == 0
    assert token_counts.attribute(docs).count() == 0
    assert secret_scan.scan_table(docs).count() == 0
    assert exact_topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert decontaminate.digest(decontaminate.leaks(docs, bench)).count() == 0
    assert decontaminate.drop_leaked(frame(spark, ["x"]), bench).count() == 1
    assert chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert language_id.identify(docs).count() == 0
    assert simhash.digest(simhash.near_duplicates(docs)).count() == 0
    assert simhash.keep_representatives(docs).count() == 0
    assert mixing.replicate(docs).count() == 0


# quality


def test_quality_draws_the_k_largest(spark):
    texts = [None, "", *[f"good fine word{k} nice" for k in range(30)], *[f"bad ugly word{k} spam" for k in range(30)], LONG]
    docs = frame(spark, texts)
    target = spark.createDataFrame([(k,) for k in range(2, 20)], "doc_id long")
    every = {r.doc_id: r for r in quality.resample(docs, target, fraction=1.0).collect()}
    assert len(every) == len(texts) and every[0].log_ratio == 0 == every[1].log_ratio
    drawn = {r.doc_id for r in quality.resample(docs, target, k=20).collect()}
    assert drawn == set(sorted(every, key=lambda i: -every[i].gumbel_key)[:20])
    means = [np.mean([every[k].log_ratio for k in ks]) for ks in (range(2, 32), range(32, 62))]
    assert means[0] > means[1]


def test_quality_ties_stand_or_fall_together(spark):
    docs = frame(spark, ["same text"] * 4 + ["other"], ids=[7, 7, 7, 7, 8])
    target = spark.createDataFrame([], "doc_id long")
    rows = quality.resample(docs, target, k=2).collect()
    assert [r.doc_id for r in rows].count(7) in (0, 4)
    assert all(r.log_ratio == 0 for r in rows)


def test_gram_counts_are_those_of_words(spark):
    a, b = quality.gram_buckets(b"One two  one\ttwo", 1 << 20), quality.gram_buckets(b"one TWO one two", 1 << 20)
    assert (np.sort(a) == np.sort(b)).all() and len(a) == 7
    assert a[0] == a[2] and a[1] == a[3] and a[4] == a[6] != a[5]


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(3).normal(size=3000)] + [5.0] * 50 + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 30, 51, 52, 1000, len(values)):
        assert common.kth_largest(df, "v", k, bins=64) == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df, "v", len(values) + 1) is None


# token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_spans_and_rules(spark, rule):
    encoding, lengths = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    texts = [t for t in ODD if t is not LONG] + ["Ünïcödé \n\n  words 𝄞𝄞\n end", "one two\nthree"]
    rows = token_counts.attribute(frame(spark, texts), rule=rule).collect()
    for k, t in enumerate(texts):
        t = t or ""
        own = sorted((r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == k)
        assert [t[a:b] for _, a, b, _ in own] == t.splitlines(keepends=True) if "\r" not in t and t and not t.endswith("\n") else True
        assert "".join(t[a:b] for _, a, b, _ in own) == t
        ids = encoding.encode_ordinary(t)
        counts, at = [0] * len(own), 0
        for i in ids:  # brute force by bytes
            data = encoding.decode_single_token_bytes(i)
            first, past = len(t.encode()[:at].decode(errors="ignore")), len(t.encode()[: at + len(data)].decode(errors="ignore"))
            past = max(past, first + 1) if t.encode()[: at + len(data)].decode(errors="replace").endswith("�") and past <= first else past
            last = past if t.encode()[: at + len(data)] == t[:past].encode() else past + 1
            share = [max(0, min(b, last) - max(a, first)) for _, a, b, _ in own]
            hit = [s for s, n in enumerate(share) if n > 0]
            counts[{"largest": int(np.argmax(share)), "start": hit[0], "end": hit[-1]}[rule]] += 1
            at += len(data)
        assert [n for *_, n in own] == counts
    assert len(lengths) >= 50_000


def test_token_counts_by_field(spark):
    docs = spark.createDataFrame([(1, "alpha beta", None, "x"), (2, None, "gamma", "y")], "doc_id long, title string, body string, text string")
    rows = token_counts.attribute(docs, ("title", "body"), "field").collect()
    assert sorted((r.doc_id, r.field, r.start, r.end) for r in rows) == [(1, 0, 0, 11), (1, 1, 11, 11), (2, 0, 0, 1), (2, 1, 1, 6)]


# secrets


def test_secret_layers(spark):
    plain = 'api_key = "AbCdEf123456"'
    twice = base64.b64encode(base64.b64encode(plain.encode())).decode()
    packed = base64.b64encode(gzip.compress(b"x " * 50 + plain.encode(), mtime=0)).decode()
    quoted = urllib.parse.quote(plain, safe="")
    escaped = "".join(f"\\u{ord(c):04x}" for c in plain)
    texts = [None, "", plain, f"see {twice} .", f"z {packed} z", f"é {quoted} end", f"𝄞 {escaped}", base64.b64encode(quoted.encode()).decode(), LONG + plain, "%25%32%35" * 20]
    rows = {r.doc_id: r for r in secret_scan.scan_table(frame(spark, texts)).collect()}
    assert (rows[0].spans, rows[1].spans, rows[0].n_spans) == ("", "", 0)
    assert rows[2].spans == "assign:0:23" and rows[2].n_assign == 1
    for k, (inner, text) in {3: (twice, texts[3]), 4: (packed, texts[4])}.items():
        kind, start, end = rows[k].spans.split(",")[0].split(":")
        assert kind == "assign" and text.index(inner) <= int(start) < int(end) <= text.index(inner) + len(inner)
        assert rows[k].n_assign == 0
    assert rows[5].spans == f"assign:2:{2 + quoted.rindex('%22')}"
    assert rows[6].spans == f"assign:2:{2 + 6 * 23}"
    assert rows[7].spans.startswith("assign:") and rows[8].spans == f"assign:{len(LONG)}:{len(LONG) + 23}"
    assert rows[9].spans == "" and all(r.complete for r in rows.values())


def test_secret_budget_and_cycles():
    bomb = base64.b64encode(gzip.compress(b"a" * 500_000, mtime=0)).decode()
    _, _, complete = secret_scan.find_secrets(bomb, budget=100_000)
    assert not complete
    assert secret_scan.find_secrets("%2525252525252541" * 3)[2]


# top-k


def brute_topk(rows, k, every):
    """Rows that share an id are rows of their own."""
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), p) for m, (p, b) in enumerate(whole) if m != n)[:k]
            out += [(q, r, p, -s) for r, (s, p) in enumerate(scored, 1)]
    return sorted(out)


def test_exact_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + k, [0.5] * 6) for k in range(60)]  # ties
    rows += [(7, [9.0] * 6), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (420, [float("nan")] * 6), (440, [float("inf")] * 6), (None, [1.0] * 6), (-20, [1.0] * 6)]
    rows += [(40, [3.0] * 6), (40, [3.0] * 6), (60, [-1.0] * 6)] + [(80, [float(k % 7)] * 6) for k in range(150)]  # ids that repeat
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, leaf string, score int").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(df, k=7, every=20, sample=64, leaves=8).collect())
    assert got == brute_topk(rows, 7, 20)


def test_exact_topk_and_its_sql_on_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.integers(0, 30, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    want = con.execute("SELECT query_id, rank, vec_id, score FROM (" + exact_topk.SEARCH_SQL.strip() + ")").fetchall()
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(df).collect()]
    assert sorted(got) == sorted(want) == brute_topk(rows, 20, 20)


def test_exact_topk_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(df, k=20, every=20).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, 20, 4096), (20, 1, 1, 8192), (20, 2, 0, 4096)]
    assert exact_topk.search(df.limit(1), k=20, every=20).count() == 0


def test_cover_tree_prunes_on_clusters():
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(size=(50, 8)) + 40 * rng.normal(size=8) for _ in range(10)])
    tree = exact_topk.CoverTree.over(points, 16)
    leaf, dist = tree.nearest(points)
    radius = np.array([dist[leaf == k].max() if (leaf == k).any() else -1.0 for k in range(len(tree.points))])
    radii = tree.radii(radius)
    bar = np.array([np.sort(points[leaf == k] @ points.T, axis=1)[:, -5].min() if (leaf == k).any() else np.inf for k in range(len(tree.points))])
    pairs = set(tree.walk(radii, radii, bar))
    assert len(pairs) < (radius >= 0).sum() ** 2
    for i, p in enumerate(points):
        assert all((leaf[i], leaf[j]) in pairs for j in np.argsort(-(points @ p))[:5])


# decontamination


ITEM = "the quick brown fox jumps over one lazy dog while eleven small birds sing near an old stone bridge at dawn and then fly far away"


def test_decontamination(spark):
    words = ITEM.split()
    swap = [w if k % 9 else "zzz" for k, w in enumerate(words)]
    inside = lambda s: "some text before , " + s + " . some text after"
    texts = [None, "", inside(ITEM.upper()), inside(" ".join(swap)), inside(" ".join(words[:10])), "entirely other words here " * 20, LONG + ITEM, inside("-".join(words)), ITEM]
    items = spark.createDataFrame([(5, ITEM, 1), (5, ITEM, 1), (None, None, 1), (6, "too short", 1), (7, "", 1)], "item_id long, text string, doc_id int")
    for rows in (common.BROADCAST_ROWS, 1):  # broadcast, and shuffled
        got = {(r.doc_id, r.item_id, r.matched, r.item_tokens) for r in decontaminate.digest(decontaminate.leaks(frame(spark, texts), items, broadcast_rows=rows)).collect()}
        n = len(words)
        assert got == {(2, 5, n, n), (3, 5, sum(a == b for a, b in zip(swap[1:], words[1:], strict=True)), n), (6, 5, n, n), (7, 5, n, n), (8, 5, n, n)}
    kept = decontaminate.drop_leaked(frame(spark, texts), items)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5] and kept.columns == frame(spark, texts).columns


def test_spaced_seeds_ignore_marked_positions():
    assert all(len(m) == decontaminate.SPAN and m.count("1") == 7 for m in decontaminate.MASKS)
    assert all(any(m[k] == "0" for m in decontaminate.MASKS) for k in (1, 2, 3, 4, 5, 6))


# chat


def chat(spark, rows):
    return spark.createDataFrame([(c, t, "user", x, "y", 7) for c, t, x in rows], "conv_id long, turn long, role string, text string, content string, depth int")


def test_quotation_linking(spark):
    rows = [
        (1, 0, "Where shall we meet on Monday evening?"),
        (1, 1, "On Tue Ann wrote:\n> Where shall we meet\n> on Monday evening?\nAt the old mill by the river."),
        (1, 2, "> > Where shall we meet on Monday evening?\n> At the old mill by the river.\nI agree with that plan."),
        (1, 3, ">Where shall we meet on Monday evening?\n\nNot Monday, please."),
        (1, 4, "> nobody said these words ever\nHm."),
        (1, 5, "> short\nok"),
        (2, 0, None), (2, 1, ""), (None, 0, "> Where shall we meet on Monday evening?"), (2, None, "> x"),
        (3, 4, "a very long message " * 3000), (3, 5, "> " + "a very long message " * 3000 + "\nyes"), (3, 5, "> " + "a very long message " * 3000 + "\nyes"),
    ]
    out = chat_format.format_chat(chat(spark, rows))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_root, r.depth) for r in out.collect()}
    assert got[1, 0] == (None, 0, 0) and got[1, 1] == (0, 0, 1) and got[1, 2] == (1, 0, 2) and got[1, 3] == (0, 0, 1)
    assert got[1, 4] == (None, 4, 0) and got[1, 5] == (None, 5, 0)
    assert got[2, 0] == (None, 0, 0) and got[None, 0] == (None, 0, 0) and got[2, None] == (None, None, 0) and got[3, 5] == (4, 4, 1)
    content = {(r.conv_id, r.turn): r.content for r in out.collect()}
    assert content[1, 1] == "At the old mill by the river." and content[1, 3] == "Not Monday, please." and content[2, 0] == "" == content[2, 1]
    assert out.count() == len(rows) and out.columns == ["conv_id", "turn", "role", "text", *chat_format.MADE]


def test_deep_threads(spark):
    says = [f"message number {k} says something new" for k in range(40)]
    rows = [(9, 0, says[0])] + [(9, k, f"> {says[k - 1]}\n{says[k]}") for k in range(1, 40)]
    got = {r.turn: (r.thread_root, r.depth) for r in chat_format.format_chat(chat(spark, rows)).collect()}
    assert got == {k: (0, k) for k in range(40)}


def test_native_plan_has_no_python(spark):
    rows = chat(spark, [(1, 0, "Where shall we meet tomorrow?"), (1, 1, "> Where shall we meet tomorrow?\nHere.")])
    for df in (chat_format.format_chat(rows), decontaminate.leaks(frame(spark, [ITEM]), spark.createDataFrame([(5, ITEM)], "item_id long, text string"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# language


TALK = {"en": "the house and the river with that man over there", "de": "das haus und der fluss mit dem mann dort drüben ist", "fr": "la maison et le fleuve avec cet homme qui est là", "es": "la casa y el río con ese hombre que está allá"}


def talk(lang, k):
    words = TALK[lang].split()
    return " ".join(words[(k * 7 + j * (1 + k % 3)) % len(words)] for j in range(12))


def test_language_hierarchy(spark):
    rows = [(lang, talk(lang, k)) for lang in TALK for k in range(40)]
    extra = [("en", None), ("en", ""), ("en", "12 34 !!"), (None, talk("fr", 3)), ("es", talk("es", 5) * 3000)]
    docs = frame(spark, [t for _, t in rows + extra], [lang for lang, _ in rows + extra])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    right = sum(got[k].lang_pred == lang for k, (lang, _) in enumerate(rows))
    assert right >= 0.97 * len(rows)
    n = len(rows)
    assert [got[n + k].lang_pred for k in range(5)] == ["und", "und", "und", "fr", "es"] and got[n].score == 0.0
    model = language_id.learn(language_id.learned_from(docs))
    assert model.families == ["germanic", "romance"] and model.langs["romance"] == ["es", "fr"]
    out = language_id.predict(docs, model)
    assert out.columns.count("lang_pred") == 1 and dict(out.dtypes)["score"] == "double"


def test_language_without_labels_or_with_one(spark):
    none = language_id.identify(frame(spark, ["some words here"] * 3, [None] * 3)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = language_id.identify(frame(spark, [talk("en", k) for k in range(30)], ["en"] * 30)).collect()
    assert {r.lang_pred for r in one} == {"en"}


# simhash


def test_covering_masks_catch_every_pair():
    masks = simhash.covering_masks(4, 1)
    rng = np.random.default_rng(0)
    for _ in range(300):
        bits = rng.choice(64, 4, replace=False)
        assert any(all(not (m >> int(b)) & 1 for b in bits) for m in masks)


def test_simhash_edge_cases(spark):
    texts = [None, "", " \t", "Same words here now", "same WORDS here\nnow", "x", LONG, LONG + "tail", "Same words here now"]
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(frame(spark, texts))).collect()}
    assert {got[k].fingerprint for k in range(3)} == {"0" * 16} and {got[k].component_id for k in range(3)} == {0}
    assert got[3].fingerprint == got[4].fingerprint == got[8].fingerprint and got[8].component_id == 3
    assert got[5].component_id == 5 and got[7].component_id == 6
    kept = simhash.keep_representatives(frame(spark, texts + ["zz"], ids=[*range(9), None]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 5, 6] and kept.count() == 5


@pytest.mark.parametrize("most", [64, 512])
def test_hamming_links_are_exact(spark, most):
    rng = np.random.default_rng(4)
    centres = rng.integers(-(1 << 62), 1 << 62, 4)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(150):
            v = int(c)
            for b in rng.choice(20, rng.integers(1, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    nodes = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    links = {(r.a, r.b) for r in simhash.hamming_links(nodes, 4, most).distinct().collect()}
    root = {v: v for v in values}

    def find(r, v):
        while r[v] != v:
            v = r[v]
        return v

    for a, b in links:
        root[find(root, a)] = find(root, b)
    want = {v: v for v in values}
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4:
                want[find(want, a)] = find(want, b)
    group = lambda r: {frozenset(v for v in values if find(r, v) == top) for top in {find(r, v) for v in values}}
    assert group(root) == group(want)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 600)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(500, 600)} == {500} and 7 not in got


# mixing


def test_mixing_rates_and_copies(spark):
    texts, sources = ["t"] * 1200, ["big"] * 900 + ["small"] * 290 + [None] * 10
    docs = frame(spark, texts, sources=sources)
    out = mixing.replicate(docs, total=3000, weights={"big": 1.0, "small": 2.0, "": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 750) < 120 and abs(n["small"] - 1500) < 160 and abs(n[None] - 750) < 120
    assert mixing.replicate(docs, weights={"small": 1.0}).where("source = 'big'").count() == 0
    rows = [(r.doc_id, r["copy"], r.shuffle_key) for r in out.collect()]
    assert len(set(rows)) == len(rows) and sorted(rows) == sorted((r.doc_id, r["copy"], r.shuffle_key) for r in mixing.replicate(docs.repartition(7), total=3000, weights={"big": 1.0, "small": 2.0, "": 1.0}).collect())
    by_doc = {}
    for d, c, _ in rows:
        by_doc.setdefault(d, []).append(c)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_doc.values())


def test_mixing_large_rates(spark):
    out = mixing.replicate(frame(spark, ["t"] * 4, sources=["a"] * 4), total=4000)
    assert abs(out.count() - 4000) < 300 and out.columns.count("copy") == 1


def test_mixing_repeated_rows_and_null_ids(spark):
    out = mixing.replicate(frame(spark, ["t", "t", None, ""], ids=[1, 1, None, 2]), total=40)
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n.get(1, 0) % 2 == 0
