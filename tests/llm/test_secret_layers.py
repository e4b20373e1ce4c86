"""Decoded layers: random nestings, every escape and window, and long layers in linear time."""

import base64
import bz2
import gzip
import random
import time
import zlib

import pytest

from marlstone.llm import secret_scan as S

SECRET = "password = hunter2hunter2"


def window(bits):
    def pack(raw):
        c = zlib.compressobj(9, zlib.DEFLATED, bits)
        return c.compress(raw) + c.flush()

    return pack


TEXT_LAYERS = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "percent-u": lambda t: "".join(f"%u{ord(c):04X}" for c in t),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "hex entities": lambda t: "".join(f"&#x{ord(c):X};" for c in t),
    "octal": lambda t: "".join(f"\\{ord(c):03o}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "base64 url": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "utf-16": lambda t: base64.b64encode(t.encode("utf-16-le")).decode(),
    **{f"zlib {b}": lambda t, b=b: base64.b64encode(window(b)(t.encode())).decode() for b in range(9, 16)},
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "bz2": lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
}


@pytest.mark.parametrize("name", list(TEXT_LAYERS))
def test_each_layer(name):
    hidden = TEXT_LAYERS[name](f"before it, {SECRET} and after it")
    text = f"ü plain {hidden} more 😀"
    spans = [x for x in S.scan_layers(text)[1] if x[1] == 0]
    assert spans and all(8 <= a < b <= 8 + len(hidden) for a, _, b in spans)
    assert "hunter2" not in S.redacted(text)


def test_random_nestings():
    r = random.Random(5)
    names = [n for n in TEXT_LAYERS if n not in ("unicode", "percent-u", "entities", "hex entities", "octal", "percent")]
    for _ in range(60):
        t = f"{'x' * r.randint(0, 5)} {SECRET} {'y' * r.randint(0, 5)}"
        for n in r.sample(names, r.randint(1, 3)) + r.choices(["percent", "unicode", "entities"], k=r.randint(0, 1)):
            t = TEXT_LAYERS[n](t)
        text = f"see {t} here"
        assert any(x[1] == 0 for x in S.scan_layers(text)[1]), text
        assert S.scan_layers(S.redacted(text))[1] == []


def test_plain_layers_hold_nothing():
    r = random.Random(6)
    for _ in range(40):
        t = "the quick fox says nothing of interest " * r.randint(1, 4)
        for n in r.sample(list(TEXT_LAYERS), 2):
            t = TEXT_LAYERS[n](t)
        assert [x for x in S.scan_layers(f"see {t} here")[1] if x[1] != 2] == []


def test_long_layers_take_linear_time():
    r = random.Random(7)
    words = " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 25))) for _ in range(80_000))

    def seconds(raw):
        began = time.process_time()
        assert S.scan_layers(base64.b64encode(raw).decode())[1] == []
        return time.process_time() - began

    small, large = seconds(words[:200_000].encode()), seconds(words[:1_000_000].encode())
    assert large < 12 * small + 1  # five times the text
    assert seconds(bytes(range(256)) * 4000) < 30
    at = 700_000
    spans = S.scan_layers(base64.b64encode(f"{words[:at]} {SECRET} {words[at : 2 * at]}".encode()).decode())[1]
    assert len(spans) == 1 and abs(spans[0][0] - at * 4 // 3) < 8
