"""Large groups of near copies that no one text stands for: components against all pairs."""

import random

import numpy as np

from orolith.llm import near_copies

WORDS = [f"w{k}" for k in range(900)]


def test_groups_without_a_middle(spark, monkeypatch):
    """Chains of copies, each changed a little from the one before, and copies of a base with many
    changes, some of which are near to each other only; parts are small."""
    monkeypatch.setattr(near_copies, "PART", 16)
    rng, texts = random.Random(9), []
    for _ in range(3):
        words = rng.choices(WORDS, k=150)
        for _ in range(25):
            words = list(words)
            words[rng.randrange(150)] = rng.choice(WORDS)
            texts.append(" ".join(words))
    base = rng.choices(WORDS, k=150)
    for n in (1, 2, 3, 4, 5, 6, 8):
        for _ in range(25):
            other = list(base)
            for at in rng.sample(range(150), n):
                other[at] = rng.choice(WORDS)
            texts.append(" ".join(other))
    sets = [near_copies.shingles(t.encode()) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in near_copies.similar(sets[i], *near_copies.index_of(sets)):
            assert 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in near_copies.keep_representatives(docs).collect()}
    assert kept == set(root) and len(kept) < len(texts) / 2
