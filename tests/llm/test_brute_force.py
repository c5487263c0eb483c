"""Operators without SQL against plain versions of themselves on random small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from orolith.llm import chat_format, decontaminate, quality

WORDS = [f"w{k}" for k in range(60)]


# decontamination


def best(doc, item, shift):
    """Most matching tokens of the best stretch, a match scoring 1 and a mismatch -4."""
    top, out = 0, 0
    for a in range(len(item)):
        score = same = 0
        for k in range(a, len(item)):
            hit = 0 <= k + shift < len(doc) and doc[k + shift] == item[k]
            score += 1 if hit else -4
            same += hit
            if score <= 0:
                break
            if score > top:
                top, out = score, same
    return out


def brute_leaks(docs, items):
    out = set()
    for d, doc in docs:
        for i, item in items:
            if not item:
                continue
            enough = len(item) if len(item) < decontaminate.SPAN else min(25, max(decontaminate.SPAN, -(-len(item) * 4 // 5)))
            if max((best(doc, item, s) for s in range(-len(item), len(doc) + 1)), default=0) >= enough:
                out.add((d, i))
    return out


@pytest.mark.parametrize("rows", [100_000, 1])
def test_leaks_with_substitutions_and_short_items(spark, rows):
    rng = random.Random(8)
    items = [(k, rng.choices(WORDS, k=n)) for k, n in enumerate([1, 2, 5, 9, 10, 11, 14, 20, 31, 40])]
    items[0] = (0, ["seldom"])
    docs = []
    for d in range(120):
        doc = rng.choices(WORDS, k=rng.choice([0, 3, 8, 40, 400]))
        if d % 2:
            item = list(rng.choice(items)[1])
            for at in range(rng.randrange(1, 9), len(item), rng.choice([7, 9, 12])):  # no two close to each other
                item[at] = "changed"
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = item
        docs.append((d, doc))
    docs += [(500, ["w1"] * 700 + items[7][1] + ["w2"] * 700), (501, items[3][1]), (502, items[3][1][:-1]), (503, [])]
    want = brute_leaks(docs, items)
    frame = spark.createDataFrame([(d, " ".join(t).upper()) for d, t in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, "-".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, broadcast_rows=rows).collect()}
    assert (501, 3) in got and (502, 3) not in got and (500, 7) in got
    assert got == want


# quality


@pytest.mark.parametrize("per_gram", [None, 50.0])
def test_quality_scores(spark, per_gram):
    rng = random.Random(2)
    texts = [None, "", *[" ".join(rng.choices(WORDS[:30] if k % 3 else WORDS[20:], k=rng.randrange(1, 60))) for k in range(60)]]
    good = {k for k in range(2, 62) if k % 3 == 0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.log_ratio for r in quality.resample(docs, spark.createDataFrame([(g,) for g in good], "doc_id long"), fraction=1.0, buckets=500, per_gram=per_gram).collect()}
    grams = [quality.gram_buckets((t or "").encode(), 500).tolist() for t in texts]
    raw, target = Counter(g for gs in grams for g in gs), Counter(g for k in good for g in grams[k])
    total = sum(raw.values()) + 500
    for k, gs in enumerate(grams):
        ratio = 0.0
        for g in gs:
            prior = (raw[g] + 1) / total
            ratio += np.log((target[g] + 500 * prior) / (sum(target.values()) + 500) / prior)
        if per_gram is not None:
            ratio *= per_gram / max(1, len(gs))
        assert got[k] == pytest.approx(ratio, abs=1e-9)


# chat


def norm(text):
    return " ".join(text.lower().split())


def brute_passages(text):
    """(level, passage) of all runs of lines of one level, and of each line."""
    lines = []
    for line in re.split(r"\r?\n", text or ""):
        prefix = re.match(r"(?:[ \t]*>)*", line)[0]
        lines.append((prefix.count(">"), norm(line[len(prefix) :])))
    out, run = set(), []
    for level, body in [*lines, (0, "")]:
        if run and (not body or run[-1][0] != level):
            out.add((run[0][0], " ".join(b for _, b in run)))
            run = []
        if body:
            run.append((level, body))
            out.add((level, body))
    return out


def brute_chat(rows):
    said = {}
    for c, t, text in rows:
        for level, p in brute_passages(text):
            if level == 0:
                said[c, p] = min(said.get((c, p), t), t)
    parent = {}
    for c, t, text in rows:
        covered = {}
        for level, p in brute_passages(text):
            if level and said.get((c, p), t) < t:
                key = (level, said[c, p])
                covered[key] = covered.get(key, 0) + len(p)
        if covered:
            parent[c, t] = min(covered, key=lambda k: (k[0], -covered[k], -k[1]))[1]
    root = {}
    for c, t, _ in sorted(rows):
        up = parent.get((c, t))
        root[c, t] = (t, 0) if up is None else (root[c, up][0], root[c, up][1] + 1)
    return parent, root


def test_chat_linking(spark):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        says = []
        for t in range(rng.choice([1, 5, 40])):
            lines = []
            if says and rng.random() < 0.7:
                for _ in range(rng.randrange(1, 3)):
                    mark = ">" * rng.randrange(1, 3)
                    lines += [f"{mark} {x.upper()}" for x in rng.choice(says).split("\n")]
            own = [" ".join(rng.choices(WORDS[:12], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))]
            says.append("\n".join(own))
            rows.append((c, t, "\n".join([*lines, "", *own])))
    rows.append((11, 900, "ok"))
    rows.append((11, 901, "> OK\nyes"))
    parent, root = brute_chat(rows)
    out = chat_format.format_chat(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in out if r.parent_turn is not None} == parent and parent[11, 901] == 900
    assert {(r.conv_id, r.turn): (r.thread_root, r.depth) for r in out} == root
    for c in range(12):
        order = sorted((root[k][0], k[1]) for k in root if k[0] == c)
        assert [(r.thread_root, r.turn) for r in sorted((r for r in out if r.conv_id == c), key=lambda r: r.position)] == order
        assert sorted(r.position for r in out if r.conv_id == c) == list(range(len(order)))


def test_positions_of_repeated_and_null_rows(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (None, 0, "x"), (None, None, "y"), (2, None, None)]
    out = chat_format.format_chat(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows) and sorted((r.turn, r.position) for r in out if r.conv_id == 1) == [(0, 0), (0, 0), (1, 2)]
    assert sorted(r.position for r in out if r.conv_id is None) == [0, 1]
