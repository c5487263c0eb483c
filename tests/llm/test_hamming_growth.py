"""Crowds of fingerprints: exact links, and how many rows each round deals."""

import itertools
import random

from orolith.llm import common, simhash

SIGN = 1 << 63


def signed(v):
    return v - (1 << 64) if v & SIGN else v


def ball(centre, radius, bits=64):
    for r in range(radius + 1):
        for at in itertools.combinations(range(bits), r):
            yield centre ^ sum(1 << k for k in at)


def rows_dealt(spark, values, monkeypatch, **how):
    """Links, and the rows of each round."""
    sizes, stored = [], common.stored

    def counting(df, name, path=None):
        out = stored(df, name, path)
        if name == "open":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", counting)
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    links = simhash.hamming_links(nodes, 4, **how)
    return {r.node: r.root for r in common.components(links).collect()}, sizes


def test_a_ball_of_radius_three_takes_one_round(spark, monkeypatch):
    """43,745 fingerprints within three bits of one: its pivots settle nearly all buckets at once."""
    values = list(ball(0x9E3779B97F4A7C15, 3))
    roots, sizes = rows_dealt(spark, values, monkeypatch)
    assert len(roots) == len(values) == 43_745 and len(set(roots.values())) == 1
    assert sum(sizes) <= 31 * len(values) // 10, sizes


def test_crowds_with_bridges_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = set(ball(centre, 1)) | {centre ^ (1 << a | 1 << b) for a, b in itertools.combinations(range(40), 2)}
    chain = centre
    for k in range(6):  # away from the crowd in steps of four bits
        chain ^= 0b1111 << (40 + 4 * k)
        values |= set(itertools.islice(ball(chain, 1), 30))
    values |= {rng.getrandbits(64) for _ in range(200)}
    values |= {centre ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in range(600)}
    roots, _ = rows_dealt(spark, values, monkeypatch, most=64)
    values = sorted(signed(v) for v in values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert roots == {v: find(v) for v in values if sum(find(w) == find(v) for w in values) > 1}


def test_representatives_of_shared_and_null_ids(spark):
    a, b = "one text of seven words stands here", "another that is not at all like it"
    rows = [(5, b), (5, a), (2, a), (2, a), (None, b), (None, "copies without id"), (None, "copies without id")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(((r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()), key=repr)
        assert got == sorted([(2, a), (5, b), (None, "copies without id")], key=repr)
