"""Runs of repeated word sequences (operator 13), by branching tandem repeats of suffix trees.

The suffix tree of a text's words is held as arrays: suffixes sorted by doubling (texts that fit in one
slice are sorted together, as no two of them share a word's number), common prefixes of neighbours
from the ranks of each doubling, and inner nodes as intervals of suffixes. At a node of d words, two of
its leaves that are d words apart and go on differently are a branching tandem repeat of period d.
Only leaves outside the node's largest child look for their partner, both ways, so a leaf is looked at
no more often than the logarithm of the words. A repeat is then rotated to the left as far as the words
agree, by descending powers of two, and repeats that end in the same run become one. A run of
`exponent` periods puts that many leaves under its node, so smaller nodes are left out.

Defined results: null and empty texts have no words and no runs; words are cut at the six white space
characters of ASCII alone, texts are bytes, so what is no UTF-8 is a word like any other; a null doc_id
makes no loop (`looped`); repeated rows are rows of their own; an empty table gives an empty result;
columns besides id and text are not read. Of runs of one stretch the smallest period counts.
A text's arrays take about 4 bytes a word for each doubling (as many as the logarithm of the longest
repeat) and some 100 bytes a word besides.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orolith.llm import words

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
SPACE = words.table_of([0x20, *range(0x09, 0x0E)])
#: Bytes of texts that are searched together, and leaves looked at together.
SLICE, LEAVES = 2 << 20, 1 << 22


@dataclass
class SuffixTree:
    """Suffixes of numbered words; `ends` has where each word's text ends."""

    codes: np.ndarray
    ends: np.ndarray
    order: np.ndarray  # suffixes, sorted
    levels: list[np.ndarray]  # levels[k][i] == levels[k][j]: the same 2**k words begin at i and j

    @classmethod
    def of(cls, codes: np.ndarray, texts: np.ndarray, ends: np.ndarray) -> SuffixTree:
        """From word numbers, the number of each word's text, and where that text ends."""
        n = len(codes)
        key = texts.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key)
        rank, slots = np.empty(n, np.int32), np.arange(n, dtype=np.int32)
        rank[order], open_ = ranked(key[order], slots)
        levels, width = [rank], 1
        slots = slots[open_]
        while len(slots):
            at = order[slots]
            then = at + width
            inside = then < ends[at]
            key = rank[at].astype(np.int64) * (n + 1)
            key[inside] += rank[then[inside]].astype(np.int64) + 1
            by = np.argsort(key)
            at = at[by]
            order[slots] = at
            rank = rank.copy()
            rank[at], open_ = ranked(key[by], slots)
            slots = slots[open_]
            levels.append(rank)
            width *= 2
        return cls(codes, ends, order, levels)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b share."""
        out = np.zeros(len(a), np.int64)
        go, n = np.flatnonzero(self.levels[0][a] == self.levels[0][b]), len(self.codes)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a[go] + out[go], b[go] + out[go]
            same = (x < n) & (y < n)
            same[same] = self.levels[k][x[same]] == self.levels[k][y[same]]
            out[go[same]] += 1 << k
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words (one at least) from a and from b are the same, all inside their texts."""
        out, power = np.zeros(len(a), bool), np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(power):
            if k < len(self.levels):
                m, level = np.flatnonzero(power == k), self.levels[k]
                rest = size[m] - (1 << int(k))
                out[m] = (level[a[m]] == level[b[m]]) & (level[a[m] + rest] == level[b[m] + rest])
        return out

    def nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Children of the inner nodes that have at least `least` leaves: (lo, hi, node) of each child, node by
        node, and (lo, hi, depth) of each node; leaves are order[lo:hi]."""
        n = len(self.order)
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = self.shared(self.order[:-1], self.order[1:])
        lcp[0] = lcp[n] = -1
        inner = np.flatnonzero(lcp > 0)
        low, high = nearest_less(lcp, inner, -1), nearest_less(lcp, inner, 1)
        wide = high - low >= least
        inner, low, high = inner[wide], low[wide], high[wide]
        by = np.argsort(low * (n + 1) + high, kind="stable")
        inner, low, high = inner[by], low[by], high[by]
        new = np.ones(len(inner), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(inner)))
        lo, hi = np.insert(inner, first, low[first]), np.insert(inner, first + count, high[first])
        return lo, hi, np.repeat(np.arange(len(first)), count + 1), low[first], high[first], lcp[inner[first]]

    def branching(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, d): where the words from i to i + d come again at i + d, and the word after differs."""
        lo, hi, node, node_lo, node_hi, depth = self.nodes(least)
        if not len(lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size, begins = hi - lo, np.flatnonzero(np.diff(node, prepend=-1))
        large = np.flatnonzero(size == np.maximum.reduceat(size, begins)[node])
        small = np.ones(len(lo), bool)
        small[large[np.unique(node[large], return_index=True)[1]]] = False
        lo, size, node = lo[small], size[small], node[small]
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        found, upto, at = [], np.cumsum(size), 0
        while at < len(lo):
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + LEAVES, "right")))
            part, which = size[at:to], np.repeat(node[at:to], size[at:to])
            leaf = self.order[np.repeat(lo[at:to] - (upto[at:to] - part - before), part) + np.arange(int(part.sum()))]
            for step in (0, -1):
                i, d, v = leaf + step * depth[which], depth[which], which
                ok = i >= 0
                i, d, v = i[ok], d[ok], v[ok]
                other = i + d if step == 0 else i
                ok = other < len(place)
                i, d, v, other = i[ok], d[ok], v[ok], other[ok]
                ok = (place[other] >= node_lo[v]) & (place[other] < node_hi[v])
                i, d = i[ok], d[ok]
                last = i + 2 * d
                ends = last >= self.ends[i]
                ends[~ends] = self.codes[i[~ends] + d[~ends]] != self.codes[last[~ends]]
                found.append(np.stack([i[ends], d[ends]]))
            at = to
        i, d = np.concatenate(found, axis=1)
        return i, d

    def runs(self, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs of at least `least` words and `exponent` (2 or more) periods, by start,
        then end; `starts` has where each word's text begins."""
        i, d = self.branching(exponent)
        back = np.maximum(least, exponent * d) - 2 * d
        ok = i - back >= starts[i] if len(i) else np.zeros(0, bool)
        i, d, back = i[ok], d[ok], back[ok]
        ok = back <= 0
        ok[~ok] = self.equal(i[~ok] - back[~ok], i[~ok] - back[~ok] + d[~ok], back[~ok])
        i, d = i[ok], d[ok]
        s = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = s - (1 << k)
            ok = to >= starts[i]
            ok[ok] = self.levels[k][to[ok]] == self.levels[k][to[ok] + d[ok]]
            s[ok] = to[ok]
        by = np.lexsort((d, i + 2 * d, s))
        s, e, d = s[by], (i + 2 * d)[by], d[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        return s[new], e[new], d[new]


def ranked(keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the slot of the first equal one, and whether another one is equal."""
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new[:-1])
    return np.repeat(slots[first], np.diff(np.append(first, len(keys)))), ~(new[:-1] & new[1:])


def nearest_less(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each index of `at` the next one in direction `step` whose value is less; both ends of values
    must be less than all others. Jumps over what a neighbour has jumped over already."""
    jump = np.arange(len(values)) + step
    go = at
    while len(go):
        go = go[values[jump[go]] >= values[go]]
        jump[go] = jump[jump[go]]
    return jump[at]


def looped(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """Which word stands at each place: itself, but in texts whose number asks for it a loop. Let h be
    crc32 of the decimal number and g = h // 10; if h % 10 is 0, each word i >= a is word a + (i - a) % p,
    with a = g % n and p = 1 + (n - a) // (3 + g % 8), n being the text's words."""
    out, at = np.arange(int(counts.sum())), np.concatenate([[0], np.cumsum(counts)])
    for k, number in enumerate(ids):
        n = int(counts[k])
        if n and number is not None and (h := zlib.crc32(b"%d" % number)) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at[k] + a : at[k + 1]] = at[k] + a + np.arange(n - a) % p
    return out


def found_in(coded: pa.DictionaryArray, counts: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, text of each run, start, end, period): the runs of texts of `counts` words each; starts and
    ends count the words of all. `which` takes other words in their places."""
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if which is not None:
        codes = codes[which]
    if not len(codes):
        return codes, *[np.zeros(0, np.int64)] * 4
    at = np.concatenate([[0], np.cumsum(counts)])
    texts = np.repeat(np.arange(len(counts)), counts)
    s, e, d = SuffixTree.of(codes, texts, at[1:][texts]).runs(at[:-1][texts])
    return codes, texts[s], s, e, d


FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def digest(ids: list[int | None], texts: pa.Array, loop: bool = True) -> list[list]:
    """The result columns besides doc_id of a slice of rows."""
    coded, counts = words.words(texts, SPACE)
    codes, text, s, e, d = found_in(coded, counts, looped(ids, counts) if loop else None)
    at = np.concatenate([[0], np.cumsum(counts)])
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, s + d, 1)
    np.add.at(cover, e, -1)
    kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
    offsets = np.searchsorted(kept, at)
    values = coded.dictionary.take(pa.array(codes[kept]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), pa.scalar(b" ", values.type))
    data, ends = words.bounds(joined)
    collapsed = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    spans = list(zip((s - at[text]).tolist(), (e - s).tolist(), d.tolist(), strict=True))
    cut = np.searchsorted(text, np.arange(len(counts) + 1)).tolist()
    out: list[list] = [[] for _ in range(7)]
    for k in range(len(counts)):
        own = sorted((a, p, n) for a, n, p in spans[cut[k] : cut[k + 1]])
        a, p, n = min(own, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
        lines = "".join(f"{x},{z},{y}\n" for x, y, z in own)
        row = (len(own), a, n, p, n and 1000 * n // p, hashlib.sha256(lines.encode()).hexdigest(), collapsed[k])
        for col, x in zip(out, row, strict=True):
            col.append(x)
    return out


def runs_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = True) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), a row for each
    row of docs. With `loop` the texts that their number picks are looped first. One pass, nothing is shuffled."""

    def run(batches):
        for whole in batches:
            whole = pa.RecordBatch.from_arrays([whole.column(0), whole.column(1).cast(pa.large_binary())], names=["doc_id", "text"])
            for batch in words.slices(whole, 1, SLICE):
                cols = digest(batch.column(0).to_pylist(), batch.column(1), loop)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, (_, kind) in zip(cols, FIELDS[1:], strict=True)]], names=[f[0] for f in FIELDS])

    schema = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in FIELDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def spans_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of each run of the texts as they are, in word numbers from 0."""

    def run(batches):
        for whole in batches:
            whole = pa.RecordBatch.from_arrays([whole.column(0), whole.column(1).cast(pa.large_binary())], names=["doc_id", "text"])
            for batch in words.slices(whole, 1, SLICE):
                coded, counts = words.words(batch.column(1), SPACE)
                _, text, s, e, d = found_in(coded, counts)
                at = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(s - at[text]), pa.array(e - s), pa.array(d)], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, start long, length long, period long")


#: crc32 of a decimal number, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda acc, x: list_reduce([xor(acc, x), 0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384::UBIGINT * (p & 1)))), 4294967295::UBIGINT)"""

RUNS_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, {CRC_SQL} AS h FROM docs),
picked AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS loops, (h // 10)::BIGINT AS g FROM hashed),
placed AS (SELECT *, CASE WHEN loops THEN g % n ELSE n END AS a, CASE WHEN loops THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM picked),
word AS (SELECT r, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT r, w, n, a, p, unnest(range(n)) AS i FROM placed)),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i > x.i JOIN placed d ON d.r = x.r WHERE 4 * (y.i - x.i) <= d.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, min(i) + count(*) + q AS e FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, e, min(q) AS q FROM stretches GROUP BY r, s, e),
dropped AS (SELECT DISTINCT word.r, word.i FROM word JOIN runs ON word.r = runs.r AND word.i >= runs.s + runs.q AND word.i < runs.e),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN dropped USING (r, i) GROUP BY r),
facts AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS l, min((s - e, s, q)) AS top FROM runs GROUP BY r)
SELECT d.doc_id, coalesce(f.n_runs, 0) AS n_runs, f.top[2]::BIGINT AS start, -f.top[1]::BIGINT AS length, f.top[3]::BIGINT AS period, (1000 * -f.top[1]) // f.top[3] AS exponent_milli,
  sha256(coalesce(f.l, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN facts f ON f.r = d.r LEFT JOIN kept k ON k.r = d.r
"""
