"""Secrets in layers that are repeated, binary or broken over lines."""

import base64
import bz2
import gzip
import lzma
import zlib

from orolith.llm.secret_scan import find_secrets

SECRET = 'api_key = "AbCdEf123456"'
CODED = base64.b64encode(SECRET.encode()).decode()


def placed(text):
    _, spans, complete = find_secrets(text)
    assert complete
    return [text[a:b] for a, _, b in spans]


def covers(text, run):
    """Some listed span lies inside the place of `run`, or around it."""
    at = text.index(run)
    return any(a < at + len(run) and at < b for a, _, b in find_secrets(text)[1])


def test_repeated_layers_are_listed_at_each_place():
    one = find_secrets(CODED)[1]
    both = find_secrets(f"{CODED} and {CODED}")[1]
    shift = len(CODED) + 5
    assert both == one + [(a + shift, k, b + shift) for a, k, b in one]


def test_one_secret_in_two_codes():
    percent = "".join(f"%{c:02x}" for c in SECRET.encode())
    text = f"{percent} {CODED}"
    assert len(find_secrets(text)[1]) == 2 and covers(text, percent) and covers(text, CODED)
    twice = base64.b64encode(CODED.encode()).decode()
    text = f"{CODED} {twice} {twice}"
    assert len(find_secrets(text)[1]) == 3


def coded(data):
    return base64.b64encode(data).decode()


def test_binary_layers_are_scanned():
    raw = SECRET.encode()
    runs = [coded("caf\xe9 ".encode("latin-1") + raw), coded(SECRET.encode("utf-16")), coded(SECRET.encode("utf-16-be")), coded(b"\x1b[31m" + raw)]
    runs += ["%00%E9" + "".join(f"%{c:02x}" for c in raw)]
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        packed = pack(b"plain text " + raw)
        runs += [coded(packed), "".join(f"%{c:02x}" for c in packed), "".join(f"\\x{c:02x}" for c in packed), repr(packed)[2:-1], coded(gzip.compress(packed))]
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        runs.append(coded(pack(b"first member ") + pack(raw)))
    for run in runs:
        text = f"see {run} ."
        assert covers(text, run), run
        assert all(4 <= a < b <= 4 + len(run) for a, _, b in find_secrets(text)[1]), run


def test_base64_wrapped_over_lines():
    for data in (b"some words before the " + SECRET.encode() + b" and more after it", gzip.compress(b"some words " * 9 + SECRET.encode())):
        run = coded(data)
        for width in (16, 30, 38):
            wrapped = "\r\n".join(run[k : k + width] for k in range(0, len(run), width))
            for text in (f"see\n{wrapped}\n", f"AHeadingOfManyLetters1\n{wrapped}\nThe end"):
                assert covers(text, wrapped), text
