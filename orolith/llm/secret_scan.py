"""Secret scans with a recursive decoding worklist (operator 4).

A text is scanned for three kinds of secrets. Then layers are unwrapped: percent-encoding, Unicode
and character escapes (surrogate pairs too), base64 runs (also wrapped over lines), UTF-16, and gzip,
zlib, bzip2 or xz data, all members, in the bytes that any of these give. Bytes that are no UTF-8 are
read as Latin-1. Words before a base64 run may shift it, so a run is decoded from each of its first
four characters. Every decoded layer joins the worklist, is scanned and unwrapped in turn, until no
layer gives a new one. A layer whose content is that of one around it is not taken again, which ends
cycles; content met at another place gives its spans there too. Each layer maps its characters to
spans of the text around it: exactly for escapes, by groups of four characters for base64, and to the
whole stream for compressed data, so a secret found deep down has a span on top.

A compressed stream is never held whole: beyond WINDOW bytes it is read as windows that overlap by
OVERLAP bytes, and streams inside it are read on from it. `complete` is false for a row if anything
may be left out: an encoded run or secret that fills a whole overlap of such windows, an xz stream
that asks for more than 128 MB of memory, or a layer beyond `budget`, an optional bound on a document's
decoded bytes against decompression bombs (none by default: memory is bounded without it, time is not).
Not layers: compressed data without a header (raw deflate, old .lzma), base32, and spaced-out hex. A
broken stream gives what comes before the break.

Defined results: null and empty texts have no spans; texts are scanned whole; bytes of a text that are
no UTF-8 are replacement characters; spans are counted in code points, end exclusive, and listed once
each; repeated rows and null ids are rows like any other; an empty table gives an empty result; columns
besides id and text are not read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in order, their patterns, and from what length on a match counts.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # of a run that is long enough; a shorter one holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LENGTH = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|[Uu]\+([0-9A-Fa-f]{4,6})"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Begins at the start of a run alone and never gives back, so that a run is looked at once.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Escapes as in a printed byte string.
PRINTED = re.compile(r"\\x([0-9A-Fa-f]{2})|\\([nrt\\'\"])")
#: Heads of compressed data. A zlib stream begins with the window's size (8 of them) and a byte that
#: makes both divisible by 31 and has the bit of preset dictionaries clear.
ZLIB = [bytes([size << 4 | 8, flag]) for size in range(8) for flag in range(256) if not flag & 32 and ((size << 4 | 8) * 256 + flag) % 31 == 0]
MAGIC = re.compile(b"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|" + b"|".join(map(re.escape, ZLIB)), re.DOTALL)
WIDE = re.compile("([\x01-\xff])\x00{1,3}")  # UTF-16 and UTF-32 of either byte order
#: Decoded bytes in a window of a long stream, what two windows share, and bytes decompressed at a time.
WINDOW, OVERLAP, PIECE, FEED = 16 << 20, 1 << 20, 1 << 20, 4096
#: An overlap of windows made of this alone may cut something that is longer than it.
UNBROKEN = re.compile(rb"[A-Za-z0-9+/_=\s-]*|[A-Za-z0-9+/_.=:\"'%\\&#;{}-]*")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of each secret in one layer."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Limits:
    """What may still be decoded of a document, and whether something was left out."""

    def __init__(self, budget: int | None):
        self.left, self.complete = float("inf") if budget is None else budget, True


@dataclass
class Layer:
    """A decoded text. Piece i begins at character cuts[i] of it: (cut, start, end, width). Character
    cut + k comes from the `width` characters at start + k * width of the text it was found in, or, with
    width 0, from the piece's whole span. So a long layer needs no map of each character."""

    text: str
    pieces: list[tuple[int, int, int, int]]
    data: bytes | None = None  # what the text was decoded from, if bytes
    more: Callable[[], Iterator[bytes]] | None = None  # the bytes that follow data in the same stream

    def __post_init__(self):
        self.cuts = [p[0] for p in self.pieces]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span in the text that the layer was found in."""
        if not self.pieces:
            return start, end
        a, b = self.pieces[bisect_right(self.cuts, start) - 1], self.pieces[bisect_right(self.cuts, end - 1) - 1]
        return a[1] + (start - a[0]) * a[3], b[1] + (end - b[0]) * b[3] if b[3] else b[2]


class Base64Layer(Layer):
    """The layer of a run whose k-th character stands at places[k]."""

    def __init__(self, data: bytes, places):
        text, utf8 = text_of(data)
        super().__init__(text, [], data)
        self.places, self.offsets = places, None
        if utf8 and len(text) < len(data):  # bytes before each character
            self.offsets = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.offsets is not None:
            start, end = int(self.offsets[start]), int(self.offsets[end])
        return int(self.places[start // 3 * 4]), int(self.places[min(len(self.places) - 1, (end + 2) // 3 * 4 - 1)]) + 1


def text_of(data: bytes) -> tuple[str, bool]:
    """data as text, and whether it is UTF-8; anything else is read as Latin-1, a character a byte."""
    try:
        return data.decode("utf-8"), True
    except UnicodeDecodeError:
        return data.decode("latin-1"), False


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded: decode gives texts and the width that each of their
    characters had in the match."""
    out, pieces, at, size = [], [], 0, 0

    def add(text: str, start: int, width: int):
        nonlocal size
        end = start + len(text) * width
        if pieces and pieces[-1][2:] == (start, width):
            pieces[-1] = (*pieces[-1][:2], end, width)
        else:
            pieces.append((size, start, end, width))
        out.append(text)
        size += len(text)
        return end

    found = False
    for m in pattern.finditer(layer.text):
        parts = decode(m)
        if parts is None:
            continue
        found = True
        if m.start() > at:
            add(layer.text[at : m.start()], at, 1)
        at = m.start()
        for text, width in parts:
            at = add(text, at, width)
    if not found:
        return None
    if at < len(layer.text):
        add(layer.text[at:], at, 1)
    return Layer("".join(out), pieces)


def percent_parts(m: re.Match) -> list[tuple[str, int]]:
    text, utf8 = text_of(bytes.fromhex(m[0].replace("%", "")))
    if not utf8 or text.isascii():
        return [(text, 3)]
    return [("".join(g), 3 * n) for n, g in groupby(text, lambda c: len(c.encode()))]


def percent_bytes(m: re.Match) -> list[tuple[str, int]]:
    return [(bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), 3)]


def printed_bytes(m: re.Match) -> list[tuple[str, int]]:
    return [(chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\r", "t": "\t"}.get(m[2], m[2]), len(m[0]))]


def narrow_parts(m: re.Match) -> list[tuple[str, int]]:
    return [(m[1], len(m[0]))]


def escape_parts(m: re.Match) -> list[tuple[str, int]] | None:
    if m[1]:
        return [((bytes.fromhex(m[1]) + bytes.fromhex(m[2])).decode("utf-16-be"), len(m[0]))]
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m[8] else 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), len(m[0]))]


def member(d, feed: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """One member's bytes in pieces; what of the feed is left goes to rest."""
    for raw in feed:
        part = d.decompress(raw, PIECE)
        while True:
            if part:
                yield part
            tail = getattr(d, "unconsumed_tail", b"")
            if d.eof or not (tail or len(part) == PIECE) and getattr(d, "needs_input", True):
                break
            part = d.decompress(tail, PIECE)
        if d.eof:
            rest.append(d.unused_data)
            return


def inflated(data: memoryview, more: Callable[[], Iterator[bytes]] | None, used: list[int], limits: Limits) -> Iterator[bytes]:
    """data, and what follows it, decompressed over all members, in pieces; used[0] becomes the
    number of bytes read. Nothing if it isn't compressed."""
    if data[:2] == b"\x1f\x8b":
        magic, make = b"\x1f\x8b", lambda: zlib.decompressobj(31)
    elif data[:3] == b"BZh":
        magic, make = b"BZh", bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\x00":
        magic, make = b"\xfd7zXZ\x00", lambda: lzma.LZMADecompressor(memlimit=1 << 27)
    else:
        magic, make = None, zlib.decompressobj
    given = [0]

    def fed() -> Iterator[bytes]:
        for at in range(0, len(data), FEED):
            given[0] += min(FEED, len(data) - at)
            yield data[at : at + FEED]
        for raw in more() if more else ():
            given[0] += len(raw)
            yield raw

    source, head = fed(), b""
    while True:
        rest: list[bytes] = []

        def feed(first=head) -> Iterator[bytes]:
            if first:
                yield first
            yield from source

        try:
            yield from member(make(), feed(), rest)
        except lzma.LZMAError as e:
            limits.complete &= "memory" not in str(e).lower()
            return
        except MemoryError:
            limits.complete = False
            return
        except (zlib.error, OSError, EOFError, ValueError):
            return
        if not rest:  # the stream ends early
            used[0] = given[0]
            return
        used[0] = given[0] - len(rest[0])
        head = rest[0].lstrip(b"\x00")  # padding between members
        while magic and len(head) < 6 and (raw := next(source, None)) is not None:
            head = (head + bytes(raw)).lstrip(b"\x00")
        if magic is None or not head.startswith(magic):
            return


def streams(data: bytes, place, limits: Limits, more: Callable[[], Iterator[bytes]] | None = None) -> Iterator[Layer]:
    """The compressed streams that begin in data, each as one layer or as overlapping windows; place
    gives the span of bytes [i, j), j being the end of data for a stream that runs on in `more`."""
    at, view = 0, memoryview(data)
    while m := MAGIC.search(data, at):
        at, used, size, held = m.start() + 1, [0], 0, bytearray()
        for part in inflated(view[m.start() :], more, used, limits):
            size += len(part)
            if size > limits.left:
                limits.complete = False
                break
            if size <= WINDOW:
                held += part
        if not size or size > limits.left:
            continue
        limits.left -= size
        at = min(len(data), m.start() + max(1, used[0]))
        span = [(0, *place(m.start(), at), 0)]
        if size <= WINDOW:
            yield Layer(text_of(bytes(held))[0], span, bytes(held))
            continue
        again = lambda lo=m.start(): inflated(view[lo:], more, [0], limits)
        past, held = 0, bytearray()
        for part in again():
            held += part
            past += len(part)
            if len(held) >= WINDOW or past == size:
                window = bytes(held)
                yield Layer(text_of(window)[0], span, window, lambda skip=past: after(again(), skip))
                limits.complete &= past == size or not UNBROKEN.fullmatch(window[-OVERLAP:])
                del held[:-OVERLAP]


def after(pieces: Iterator[bytes], skip: int) -> Iterator[bytes]:
    """The bytes of the pieces without the first `skip` ones."""
    for part in pieces:
        if len(part) > skip:
            yield part[skip:]
        skip = max(0, skip - len(part))


def viewed_streams(view: Layer | None, limits: Limits) -> Iterator[Layer]:
    """The compressed streams in a text whose characters below 256 are bytes."""
    if view:
        for m in re.finditer("[\x00-\xff]+", view.text):
            yield from streams(m[0].encode("latin-1"), lambda i, j, at=m.start(): view.origin(at + i, at + j), limits)


def base64_layer(run: str, places) -> Layer | None:
    """The layer of a run whose k-th character stands at places[k]; a last character that is too
    much is left out."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return Base64Layer(data, places[: len(run)]) if data else None


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """Decoded runs of the layer, each by itself, and those of several lines together, from each of
    their first four characters and those of each alignment that a line begins with."""
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        for k in range(4 if len(run) > 16 else 1):
            if new := base64_layer(run[k:], range(m.start() + k, m.start() + len(run))):
                yield new
    for m in WRAPPED.finditer(layer.text) if "\n" in layer.text else ():
        parts, starts, size = [], {}, 0
        for part in re.finditer("[A-Za-z0-9+/_-]+", m[0]):
            starts.setdefault(size % 4, size)
            size += len(part[0])
            parts.append(np.arange(m.start() + part.start(), m.start() + part.end()))
        places, run = np.concatenate(parts), re.sub(r"[\s=]", "", m[0])
        for k in sorted({0, 1, 2, 3, *starts.values()}):
            if new := base64_layer(run[k:], places[k:]):
                yield new


def decoded(layer: Layer, limits: Limits) -> Iterator[Layer]:
    if "%" in layer.text and (new := replaced(layer, PERCENT, percent_parts)):
        yield new
        yield from viewed_streams(replaced(layer, PERCENT, percent_bytes), limits)
    if ("\\" in layer.text or "&#" in layer.text or "+" in layer.text) and (new := replaced(layer, ESCAPE, escape_parts)):
        yield new
        yield from viewed_streams(new, limits)
    if "\\x" in layer.text:
        yield from viewed_streams(replaced(layer, PRINTED, printed_bytes), limits)
    if "\x00" in layer.text and (new := replaced(layer, WIDE, narrow_parts)):
        yield new
    yield from base64_layers(layer)
    if layer.data:
        same = len(layer.data) == len(layer.text)
        yield from streams(layer.data, lambda i, j: (i, j) if same else (0, len(layer.text)), limits, layer.more)


def name_of(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


class Frame:
    """A layer at work: its spans so far, its inner layers to come, and the ancestors at which one of them was cut."""

    def __init__(self, layer: Layer, limits: Limits):
        self.layer, self.name, self.spans = layer, name_of(layer.text), set(scan(layer.text))
        self.inner, self.cut = decoded(layer, limits), set()


def find_secrets(text: str | None, budget: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """Base spans, all spans (each as start, kind number, end, sorted), and whether nothing was left out.

    Layers are taken depth first, and a content's spans are found once, in its own offsets; each place
    that holds the content maps them to its own span.
    """
    limits = Limits(budget)
    stack, found = [Frame(Layer(text or "", []), limits)], {}
    base, active = sorted(stack[0].spans), {stack[0].name}
    while True:
        frame = stack[-1]
        new = next(frame.inner, None)
        if new is None:
            stack.pop()
            active.discard(frame.name)
            frame.cut.discard(frame.name)
            if not stack:
                return base, sorted(frame.spans), limits.complete
            if not frame.cut and not frame.layer.more:
                found[frame.name] = frame.spans
            stack[-1].cut |= frame.cut
            stack[-1].spans |= {placed(frame.layer, s) for s in frame.spans}
            continue
        name = name_of(new.text)
        if name in active and not new.more:
            frame.cut.add(name)
        elif name in found and not new.more:
            frame.spans |= {placed(new, s) for s in found[name]}
        elif len(new.text) > limits.left:
            limits.complete = False
        else:
            limits.left -= 0 if new.data and new.pieces else len(new.text)  # streams are counted as they are read
            stack.append(Frame(new, limits))
            active.add(name)


def placed(layer: Layer, span: tuple[int, int, int]) -> tuple[int, int, int]:
    lo, hi = layer.origin(span[0], span[2])
    return lo, span[1], hi


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans, complete) for each row; the
    counts and the hash are of the base spans. One pass, nothing is shuffled."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                text = (data or b"").decode(errors="replace")
                base, every, complete = find_secrets(text, budget)
                n = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every), complete))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "complete"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, complete boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
