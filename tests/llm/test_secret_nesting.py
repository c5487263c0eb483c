"""Random nestings of all encoders around a secret: it is found, and inside the place of its code."""

import base64
import bz2
import gzip
import lzma
import random
import urllib.parse
import zlib

import pytest

from orolith.llm import secret_scan
from orolith.llm.secret_scan import find_secrets, scan_table

SECRET = 'api_key = "AbCdEf123456"'


def small_window(data, bits):
    c = zlib.compressobj(9, zlib.DEFLATED, bits)
    return c.compress(data) + c.flush()


def coded(data):
    return base64.b64encode(data).decode()


def wrapped(data, width):
    run = coded(data)
    return "\n".join(run[k : k + width] for k in range(0, len(run), width))


#: From bytes to bytes.
PACKS = [gzip.compress, bz2.compress, lzma.compress, zlib.compress, lambda d: zlib.compress(d, 1), lambda d: small_window(d, 9), lambda d: small_window(d, 12), lambda d: gzip.compress(b"first ") + gzip.compress(d), lambda d: bz2.compress(b"first ") + bz2.compress(d), lambda d: b"\x93 head " + gzip.compress(d) + b"tail"]
#: From bytes to text.
CODES = [coded, lambda d: base64.urlsafe_b64encode(d).decode().rstrip("="), lambda d: wrapped(d, 20), lambda d: "".join(f"%{c:02X}" for c in d), lambda d: "".join(f"\\x{c:02x}" for c in d), lambda d: "https://x.com/" + coded(d), lambda d: "ab" + coded(d) + "/c"]
#: From text to text.
WRITTEN = [lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(f"\\U{ord(c):08x}" for c in t), lambda t: t.encode("utf-16").decode("latin-1"), lambda t: "é " + t, lambda t: "caf\xe9 \U0001d11e " + t]


def nest(rng, depth):
    text = SECRET
    for _ in range(depth):
        if rng.random() < 0.5:
            data = text.encode(rng.choice(["utf-8", "utf-16-le"]))
            for _ in range(rng.choice([0, 1, 1, 2])):
                data = rng.choice(PACKS)(data)
            text = rng.choice(CODES)(data)
        else:
            text = rng.choice(WRITTEN)(text)
    return text


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_random_nestings(depth):
    rng = random.Random(depth)
    for k in range(150 if depth < 3 else 60):
        run = nest(rng, depth)
        if len(run) > 300_000:
            continue
        text = f"some words \U0001d11e see {run} ."
        at = text.index(run)
        _, spans, complete = find_secrets(text)
        assert complete and any(kind == 0 and at - 1 <= a < b <= at + len(run) for a, kind, b in spans), (k, run[:200])


def test_each_alone():
    for pack in PACKS:
        for code in CODES:
            run = code(pack(b"plain words here " + SECRET.encode()))
            _, spans, complete = find_secrets(f"x {run}\ny")
            assert complete and spans, run


def test_surrogate_pairs_and_plain_runs():
    assert secret_scan.replaced(secret_scan.Layer("a\\ud834\\udd1eb", []), secret_scan.ESCAPE, secret_scan.escape_parts).text == "a\U0001d11eb"
    assert find_secrets("token: \\ud834\\udd1e" + "".join(f"\\u{ord(c):04x}" for c in SECRET))[1]
    for word in ("a" * 40, "A" * 40, "0" * 20):  # runs of one case are decoded like any other
        assert find_secrets(word)[2]
    lower = next(c for k in range(100000) if (c := coded(b"token=%08d" % k)).isalpha() or k == 99999)
    assert find_secrets(lower)[1]


def test_empty_and_broken_streams():
    assert find_secrets(coded(gzip.compress(b"")) + " x")[2]
    whole = gzip.compress(b" ".join(b"%d" % (k * k) for k in range(20_000)) + SECRET.encode())
    _, spans, complete = find_secrets(coded(whole[:-200]))
    assert complete and not any(k == 0 for _, k, _ in spans)
    early = gzip.compress(SECRET.encode() + b" " + random.Random(1).randbytes(50_000))
    assert find_secrets(coded(early[:-200]))[1]


def test_long_streams_are_read_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 1 << 15)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 12)
    rng = random.Random(3)
    filler = lambda n: b" ".join(b"%d," % rng.randrange(10**6) for _ in range(n))
    inner = gzip.compress(filler(6_000) + b" token: zzzzzzzzzz, " + filler(10))  # longer than a window itself
    for hidden in (SECRET.encode(), coded(SECRET.encode()).encode(), inner):
        for before in (0, 4_700, 9_000):
            data = filler(before) + b"\n" + hidden + b"\n" + filler(5_000)
            for pack in (gzip.compress, bz2.compress, lzma.compress):
                text = "see " + coded(pack(data)) + " ."
                _, spans, complete = find_secrets(text)
                assert complete and any(k == 0 and 4 <= a < b <= len(text) - 2 for a, k, b in spans), (before, pack)
    long = b"token: " + b"ab12" * 50_000
    _, spans, complete = find_secrets(coded(gzip.compress(filler(8_000) + long + filler(9_000))))
    assert spans and not complete


def test_memory_limit_and_budget_are_told():
    big = lzma.compress(b"x" * 100 + SECRET.encode(), filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 28}])
    assert not find_secrets(coded(big))[2]
    bomb = coded(gzip.compress(b"a b," * 500_000))
    assert find_secrets(bomb)[2] and not find_secrets(bomb, budget=1_000_000)[2]


def test_bytes_that_are_no_utf8(spark):
    docs = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF20746F6B656E3D6162636465663132' AS STRING) AS text")
    assert [r.spans for r in scan_table(docs).collect()] == ["assign:3:17"]
