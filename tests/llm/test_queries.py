"""Registered queries over whole small tables: against SQL where there is one, else brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
import zlib
from compare import DATA, same

from orolith.llm import queries

SF = f"{DATA}/sf0.001"


def documents(sf=SF):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest id reachable, by id, over links of at most four differing bits."""
    values = sorted(set(fps.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 62)
    for k, v in fps.items():
        low[find(v)] = min(low[find(v)], k)
    return {k: low[find(v)] for k, v in fps.items()}


def test_simhash_near_dedup(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in documents()}
    comps = brute_components(fps)
    assert got == {k: (f"{v:016x}", comps[k]) for k, v in fps.items()}
    assert len(set(comps.values())) < len(comps)


BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def brute_spans(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [s for *_, s in sorted(found)]


def test_secret_scan(spark):
    got = {r.doc_id: r for r in queries.op4_secret_scan(spark, f"{DATA}/sf0.01").collect()}
    for d in documents(f"{DATA}/sf0.01"):
        spans, r = brute_spans(d["text"]), got[d["doc_id"]]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])
    assert any(r.n_assign for r in got.values())


def test_language_id(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, f"{DATA}/sf0.01").collect()}
    docs = pq.read_table(f"{DATA}/sf0.01/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held} == {k for k, r in got.items() if r.held_out}
    right = sum(got[d["doc_id"]].lang_pred == d["lang"] for d in held if d["lang"])
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_exact_topk_is_brute_force(spark):
    """The same as SQL, by way of numpy on a larger table."""
    t = pq.read_table(f"{DATA}/sf0.01/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.floor(64 * np.stack(t["embedding"].to_pylist()).astype(float)).astype(int)
    got = defaultdict(list)
    for r in queries.op5_exact_topk(spark, f"{DATA}/sf0.01").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        best = sorted((-int(s), int(i)) for i, s in zip(ids, score, strict=True) if i != ids[q])[:20]
        assert got[ids[q]] == [(i, -s) for s, i in best]


def test_benchmark_decontamination(spark):
    """All items that stand whole in a document are found, and nothing else here."""
    words = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    items = [(r["item_id"], words(r["text"])) for r in pq.read_table(f"{DATA}/sf0.01/benchmark.parquet").to_pylist()]
    docs = [(r["doc_id"], words(r["text"] or "")) for r in pq.read_table(f"{DATA}/sf0.01/documents.parquet").to_pylist()]
    want = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r.doc_id, r.item_id) for r in queries.op6_benchmark_decontamination(spark, f"{DATA}/sf0.01").collect()}
    assert want and got == want


def test_chat_formatting_keeps_all_messages(spark):
    rows = queries.op7_chat_formatting(spark, SF).collect()
    table = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    assert sorted((r.conv_id, r.turn) for r in rows) == sorted((d["conv_id"], d["turn"]) for d in table)
    assert all(r.parent_turn is None and r.depth == 0 for r in rows)  # this table has no quotes


def test_token_counts_add_up(spark):
    from orolith.llm import token_counts

    encoding, _ = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    total = defaultdict(int)
    for r in queries.op3_token_counts(spark, SF).collect():
        total[r.doc_id] += r.n_tokens
    assert total == {d["doc_id"]: len(encoding.encode_ordinary(d["text"] or "")) for d in documents()}


def test_quality_resampling_draws_the_wanted_share(spark):
    docs, labels = len(documents()), pq.read_table(f"{SF}/labels.parquet").to_pylist()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"]}
    bad = {r["doc_id"] for r in labels} - good
    drawn = {r.doc_id for r in queries.op2_quality_resampling(spark, SF).collect()}
    assert round(len(good) / len(labels) * docs) <= len(drawn) <= docs
    assert len(drawn & good) / len(good) > len(drawn & bad) / max(1, len(bad))
