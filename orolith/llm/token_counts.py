"""Token counts by offset-mapped attribution (operator 3).

A document's fields are joined by line feeds and encoded once as a whole. Each token's character
span follows from the byte lengths of the tokens; a merge join of the sorted spans with the sorted
sections (lines, or whole fields) places the tokens. A token that crosses a boundary goes to one
section by an explicit rule: `largest` (the section with most of its characters, the first of
equals), `start` (that of its first character) or `end` (that of its last). So the sections'
counts add up to the document's.

A line feed belongs to the section that it ends. Spans are counted in code points, end exclusive;
a token that starts or ends inside a character's bytes takes in that character. The vocabulary is
a file of byte-level BPE ranks, read by the driver and sent along with the tasks.

Runs of thousands of blanks are more than the split pattern's engine can take, so such a run is cut
out beforehand just as the pattern would cut it: all of it is one piece, or all but its last
character if a word follows. The tokens are those of the whole text.

Defined results: a null field is empty; an empty document has one section without tokens; texts
are encoded whole; bytes that are no UTF-8 are read as replacement characters (U+FFFD), and spans
count those; repeated rows and null ids are rows like any other; an empty table gives an empty
result; columns besides the id and the fields are not read.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE ranks for many languages, where the image keeps public tokenizers.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("largest", "start", "end")
#: Blanks as the split pattern knows them (the White_Space property), in runs too long for its engine.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


def encoder(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of each token."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """The tokens of a whole text."""
    out, at = [], 0
    for m in LONG_BLANK.finditer(text):
        out += encoding.encode_ordinary(text[at : m.start()])
        at = m.end() - (m.end() < len(text))
        out += encoding._core_bpe.encode_single_piece(text[m.start() : at].encode())
    return out + encoding.encode_ordinary(text[at:])


def token_spans(text: str, encoding: tiktoken.Encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token."""
    ends = np.cumsum(lengths[np.array(encode(text, encoding), np.int64)])
    if not len(ends):
        return ends, ends
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[np.concatenate([[0], ends[:-1]])], character[ends - 1] + 1


def place(first: np.ndarray, past: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary."""
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, past - 1, side="right") - 1
    out = b.copy() if rule == "end" else a.copy()
    if rule == "largest":
        for i in np.flatnonzero(a != b):
            cuts = np.concatenate([[first[i]], starts[a[i] + 1 : b[i] + 1], [past[i]]])
            out[i] = a[i] + int(np.diff(cuts).argmax())
    return out, a != b


def attribute(docs: DataFrame, fields: tuple[str, ...] = ("text",), by: str = "line", rule: str = "largest", vocabulary: str = VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, section, field, start, end, n_tokens, n_crossing): a row for each section, numbered
    from 0 in a document; start and end count characters of the joined fields."""
    if rule not in RULES or by not in ("line", "field"):
        raise ValueError(f"rule is one of {RULES}, by is line or field")
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(batches):
        encoding, lengths = encoder(ranks)
        for batch in batches:
            out, sizes = [], []
            for values in zip(*[c.cast(pa.binary()).to_pylist() for c in batch.columns[1:]], strict=True):
                values = [(v or b"").decode(errors="replace") for v in values]
                text = "\n".join(values)
                heads = np.cumsum([0] + [len(v) + 1 for v in values[:-1]])
                starts = heads
                if by == "line":
                    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                    starts = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
                section, crosses = place(*token_spans(text, encoding, lengths), starts, rule)
                n = np.bincount(section, minlength=len(starts))
                over = np.bincount(section, weights=crosses, minlength=len(starts)).astype(np.int64)
                field = np.searchsorted(heads, starts, side="right") - 1
                out.append((np.arange(len(starts)), field, starts, np.append(starts[1:], len(text)), n, over))
                sizes.append(len(starts))
            if not out:
                continue
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing"])

    sent = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return sent.mapInArrow(run, "doc_id long, section long, field long, start long, end long, n_tokens long, n_crossing long")
