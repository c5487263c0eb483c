"""Texts that a tokenizer may break on: very long runs of one kind, and bytes that are no UTF-8."""

import regex

from orolith.llm import token_counts


def brute(text, encoding):
    """Split by the pattern with another engine, each piece merged by itself."""
    return [t for piece in regex.findall(token_counts.PATTERN, text) for t in encoding._core_bpe.encode_single_piece(piece.encode())]


def test_long_runs_are_encoded_as_a_whole():
    encoding, _ = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    n = 20_000
    for blank in (" ", "\n", "\t 　"):
        for text in (blank * n, f"a{blank * n}b", f"{blank * n}\nb  c", f"x {blank * n}'s", f"a{blank * n}b{blank * n} c", f"{blank * n}12", f"é{blank * n}\U0001d11e", f"a{blank * n}\x1c"):
            assert token_counts.encode(text, encoding) == brute(text, encoding), repr(text[:3])
            short = text.replace(blank * n, blank * 9)
            assert token_counts.encode(short, encoding) == encoding.encode_ordinary(short) == brute(short, encoding)


def test_a_million_of_one_character(spark):
    n = 1_000_000
    texts = [" " * n, "\n" * n, "word" + " " * n + "word", "a" * n, "!" * n, "1" * n, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoding, _ = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    got = {}
    for r in token_counts.attribute(docs).groupBy("doc_id").agg({"n_tokens": "sum", "end": "max", "section": "count"}).collect():
        got[r.doc_id] = (r["sum(n_tokens)"], r["max(end)"])
    assert got == {k: (len(brute(t or "", encoding)), len(t or "")) for k, t in enumerate(texts)}


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1 AS doc_id, decode(X'6162', 'UTF-8') AS text UNION ALL SELECT 2, CAST(X'61FF620A63' AS STRING)")
    rows = sorted((r.doc_id, r.section, r.start, r.end) for r in token_counts.attribute(docs).collect())
    assert rows == [(1, 0, 0, 2), (2, 0, 0, 4), (2, 1, 4, 5)]
