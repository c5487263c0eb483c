"""Near copies against brute force over all pairs."""

import random

from corpus_pipeline import near_dedup

WORDS = [f"w{k}" for k in range(900)]


def brute(rows):
    """Ids that stay: the least of each component of Jaccard 0.8 or more."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def test_near_dedup_links_all_of_similarity_08(spark):
    rng, rows = random.Random(5), []
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.randint(60, 200))
        rows.append(" ".join(base))
        for n in (1, 2, 3, 5, 8):
            other = list(base)
            for at in rng.sample(range(len(base)), n):
                other[at] = rng.choice(WORDS)
            rows.append(" ".join(other))
    rows += ["", "  ", "one two three", "ONE two  three", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == brute(rows)


def test_near_dedup_of_shared_and_null_ids(spark):
    """Rows of one id with different texts both stay; of exact copies with null ids one stays."""
    rows = [(1, "one text of seven words stands here"), (1, "another that is not at all like it"), (1, "one text of seven words stands here"), (None, "copies of a text without any id"), (None, "copies of a text without any id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in near_dedup(spark, docs, "").collect()]
    assert len(got) == 3 and set(got) == set(rows)
