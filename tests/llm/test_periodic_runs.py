"""Operator 13: runs by branching tandem repeats against a plain search of every period."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
from orolith.llm import periodic_runs, words


def plain_runs(w):
    """Runs by trying each period at each place."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def runs_of(texts):
    coded, counts = words.words(pa.array(texts, pa.string()).cast(pa.large_binary()), periodic_runs.SPACE)
    _, text, s, e, d = periodic_runs.found_in(coded, counts)
    at, out = np.concatenate([[0], np.cumsum(counts)]), [[] for _ in texts]
    for x, a, b, q in zip(text.tolist(), s.tolist(), e.tolist(), d.tolist(), strict=True):
        out[x].append((a - int(at[x]), b - a, q))
    return [sorted(r) for r in out]


def test_runs_equal_a_plain_search_on_random_texts():
    rnd = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            letters, w = rnd.choice(["a", "ab", "abc"]), []
            while len(w) < rnd.randint(0, 60):
                w += [rnd.choice(letters) for _ in range(rnd.randint(1, 5))] * rnd.choice([1, 1, 2, 4, 5, 9])
            texts.append(" ".join(w) if rnd.random() > 0.05 else None)
        assert runs_of(texts) == [plain_runs((t or "").split()) for t in texts]


def test_leaves_looked_at_in_parts_give_the_same(monkeypatch):
    text = " ".join(random.Random(1).choices("ab", k=400)) + " x y z" * 20
    whole = runs_of([text])
    monkeypatch.setattr(periodic_runs, "LEAVES", 7)
    assert runs_of([text]) == whole and len(whole[0]) > 3


def test_long_texts_take_time_in_proportion():
    for text in ("the " * 300_000, "ab cd ef " * 100_000, " ".join(map(str, range(300_000)))):
        began = time.time()
        found = runs_of([text])[0]
        assert time.time() - began < 10
        assert found == [] or found == [(0, 300_000, len(set(text.split())))]


def test_words_are_cut_at_six_ascii_characters_alone(spark):
    docs = spark.createDataFrame([(1, "a\tb\x0bc\x0cd\re\nf g h i"), (2, None), (3, ""), (4, " \n ")], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic_runs.runs_table(docs, loop=False).collect()}
    assert rows[1].collapsed_sha256 == hashlib.sha256("a b c d e f g h i".encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((rows[k].n_runs, rows[k].start, rows[k].period, rows[k].runs_sha256, rows[k].collapsed_sha256) == (0, None, None, empty, empty) for k in (2, 3, 4))


def test_the_longest_run_ties_and_what_stays(spark):
    text = "x " + "a b " * 3 + "a q " + "c " * 6 + "d e f " * 4 + "c c c c c c c"
    docs = spark.createDataFrame([(5, text, "z", 1), (5, text, "z", 1), (None, text, None, 2)], "doc_id long, text string, period string, start int")
    rows = periodic_runs.runs_table(docs, loop=False).collect()
    want = plain_runs(text.split())
    assert want == [(9, 6, 1), (15, 12, 3), (27, 7, 1)] and len(rows) == 3
    kept = "x a b a b a b a q c d e f c"
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (3, 15, 12, 3, 4000)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    spans = periodic_runs.spans_table(docs).where("doc_id = 5").distinct().collect()
    assert sorted((r.start, r.length, r.period) for r in spans) == want
    assert periodic_runs.runs_table(docs.limit(0)).count() == 0


def test_bytes_that_are_no_text_are_words(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(unhex('FF20FF20FF20FF20FF20FF20C3') AS STRING) AS text")
    r = periodic_runs.runs_table(docs, loop=False).first()
    assert (r.n_runs, r.length, r.period) == (1, 6, 1) and r.collapsed_sha256 == hashlib.sha256(b"\xff \xc3").hexdigest()


def test_looped_texts_equal_the_sql(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k * 7 - 40, " ".join(rnd.choices(["a", "b", "cc", "d"], k=rnd.randint(0, 90))) if k % 11 else None) for k in range(160)] + [(9, "same " * 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r[c] for c in sorted(r.asDict())) for r in periodic_runs.runs_table(docs).collect())))
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    out = c.execute(periodic_runs.RUNS_SQL)
    cols = [x[0] for x in out.description]
    assert got == sorted(str(tuple(r[cols.index(x)] for x in sorted(cols))) for r in out.fetchall())
