"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secrets; then every encoded layer in it is unwrapped (percent escapes, Unicode, octal and numeric character escapes,
base64 in one run or wrapped over lines, compressed bytes, UTF-16) and scanned in turn, and so is every layer inside that, until
no new layer appears.  Decoded bytes need not be readable as a whole: those that are not UTF-8 become lone surrogates, which keep
their value, so a secret or a compressed stream among other bytes is found.
A layer seen before at the same place is not taken up again, so self-reproducing layers end.  Each layer carries, for every
character, the span of the original text it came from, so what is found inside is reported in the original's code points.

Defined results: a null or empty text has no spans; equal spans of one kind are reported once; a null doc_id stays null;
repeated rows are scanned each; no rows, no result rows.  Other columns are ignored by secret_scan() and passed on by
redact_secrets(), whatever their names.  A compressed layer is unwrapped to its end, in chunks of CHUNK bytes that share OVERLAP
bytes, a bound on memory; a damaged one as far as it goes.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from io import StringIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&\#[xX]([0-9A-Fa-f]{1,6});|&\#([0-9]{1,7});|\\([0-3][0-7]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t>]*+\r?\n[\x20\t>]*+[A-Za-z0-9+/_-]++)+")
OUTSIDE = re.compile(r"[^A-Za-z0-9+/_-]+")
# zlib's two bytes for each window size: together a multiple of 31, without a preset dictionary
ZLIB = b"|".join(re.escape(bytes([window, flags])) for window in range(0x08, 0x80, 0x10) for flags in range(256) if (window * 256 + flags) % 31 == 0 and not flags & 0x20)
MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\x00|" + ZLIB)
SPACED = re.compile("(?:[^\0]\0{1,3}){8}|(?:\0{1,3}[^\0]){8}")  # eight ASCII characters in UTF-16 or UTF-32: fewer hold no secret
CHUNK, OVERLAP = 32 << 20, 16 << 20
PIECE = 64
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret in plain text."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """Decoded text; locate(a, b) is the original text's span that characters a to b - 1 came from, and whole() that of all, which outer gives without places inside."""

    text: str
    locate: Callable[[int, int], tuple[int, int]]
    outer: Callable[[], tuple[int, int]] | None = None

    def whole(self) -> tuple[int, int]:
        return self.outer() if self.outer else self.locate(0, len(self.text))

    def part(self, a: int, b: int) -> Layer:
        return Layer(self.text[a:b], lambda i, j: self.locate(a + i, a + j))


def _replaced(layer: Layer, pattern: re.Pattern, decode, places) -> Layer:
    """The whole layer with every match decoded.  places(match, i) is the span in the match of its decoded character i."""
    out, at = StringIO(), 0
    made, taken, until = array("q"), array("q"), array("q")  # where each match's characters begin in the new text, and its span in the old one
    size = 0
    for m in pattern.finditer(layer.text):
        a, b = m.span()
        out.write(layer.text[at:a])
        size += a - at
        made.append(size)
        taken.append(a)
        until.append(b)
        chars = decode(m)
        out.write(chars)
        size += len(chars)
        at = b
    out.write(layer.text[at:])
    last: list = [None, None, 0]

    def span(i: int) -> tuple[int, int]:
        k = bisect_right(made, i) - 1
        if k < 0:
            return i, i + 1
        if last[0] != k:
            m = pattern.match(layer.text, taken[k])
            last[:] = k, m, len(decode(m))
        if i - made[k] < last[2]:
            a, b = places(last[1], i - made[k])
            return taken[k] + a, taken[k] + b
        x = until[k] + i - made[k] - last[2]
        return x, x + 1

    return Layer(out.getvalue(), lambda i, j: layer.locate(span(i)[0], span(j - 1)[1]))


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")


@lru_cache(maxsize=2)
def _percent_ends(escaped: str) -> np.ndarray:
    return _byte_ends(bytes.fromhex(escaped.replace("%", "")).decode("utf-8", "surrogateescape"))


def _percent_place(m: re.Match, i: int) -> tuple[int, int]:
    ends = _percent_ends(m[0])
    return 3 * int(ends[i - 1]) if i else 0, 3 * int(ends[i])


def _escape(m: re.Match) -> str:
    code = int(m[7]) if m[7] else int(m[8], 8) if m[8] else int(m[1] or m[2] or m[3] or m[4] or m[5] or m[6], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _whole(m: re.Match, i: int) -> tuple[int, int]:
    return 0, len(m[0])


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _byte_ends(text: str) -> np.ndarray:
    """Where each character of a text ends in its bytes."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.cumsum(np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)))


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) == 2:
        return zlib.decompressobj()
    if head[:1] == b"B":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj()


def _inflate(raw: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Decompressed pieces of the stream that begins at a place, and where in raw each ends; streams right behind it are taken with it."""
    while (m := MAGIC.match(raw, at)) is not None:
        d = _decompressor(m[0])
        while not d.eof and at < len(raw):
            piece = raw[at : at + PIECE]
            at += len(piece)
            try:
                out = d.decompress(piece)
            except (zlib.error, zstandard.ZstdError, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if d.eof:
                at -= len(d.unused_data)
            yield out, at
        if not d.eof:
            return


def _inflated(layer: Layer, raw: bytes, byte_ends: np.ndarray | None = None) -> Iterator[Layer]:
    """The compressed layers among a layer's bytes; without byte_ends a character is a byte."""
    at = 0
    while (m := MAGIC.search(raw, at)) is not None:
        at = m.start() + 1
        size, end = 0, 0
        for out, after in _inflate(raw, m.start()):
            size += len(out)
            end = after if out else max(end, after)
        if not size:
            continue
        byte_ends = _byte_ends(layer.text) if byte_ends is None and len(raw) != len(layer.text) else byte_ends
        first, last = (m.start(), end - 1) if byte_ends is None else np.searchsorted(byte_ends, [m.start(), end - 1], "right").tolist()
        held = bytearray()
        for out, _ in _inflate(raw, m.start()):
            held += out
            if len(held) >= CHUNK:
                text = held.decode("utf-8", "surrogateescape")
                yield Layer(text, lambda i, j, first=first, last=last: layer.locate(first, last + 1))
                del held[:-OVERLAP]
        text = held.decode("utf-8", "surrogateescape")
        yield Layer(text, lambda i, j, first=first, last=last: layer.locate(first, last + 1))


def _unbase64(run: Layer) -> Iterator[Layer]:
    """What a base64 run decodes to.  It may begin inside another word or path, so all four alignments are taken, each to the end of the run."""
    plain = run.text.replace("-", "+").replace("_", "/")
    for shift in range(4):
        n = len(plain) - shift
        n -= n % 4 == 1
        if n < 16:
            return
        text = base64.b64decode(plain[shift : shift + n] + "=" * (-n % 4)).decode("utf-8", "surrogateescape")

        ends: list[np.ndarray] = []  # where each character ends in the bytes, worked out once if any is asked for

        def locate(i: int, j: int, shift=shift, n=n, text=text, ends=ends) -> tuple[int, int]:
            if not ends:
                ends.append(_byte_ends(text))
            before, after = int(ends[0][i - 1]) if i else 0, int(ends[0][j - 1])
            return run.locate(shift + before * 4 // 3, shift + min(n - 1, (after * 4 - 1) // 3) + 1)

        yield Layer(text, locate, lambda shift=shift, n=n: run.locate(shift, shift + n))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    if "%" in layer.text and PERCENT.search(layer.text):
        yield _replaced(layer, PERCENT, _percent, _percent_place)
    if ("\\" in layer.text or "%u" in layer.text or "&#" in layer.text) and ESCAPE.search(layer.text):
        plain = _replaced(layer, ESCAPE, _escape, _whole)
        yield plain
        yield from _inflated(plain, plain.text.encode("latin-1", "replace"))  # escapes of single bytes
    if "\0" in layer.text and SPACED.search(layer.text):  # of either order
        at = np.flatnonzero(np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), "<u4"))
        yield Layer(layer.text.replace("\0", ""), lambda i, j: layer.locate(int(at[i]), int(at[j - 1]) + 1))
    yield from _inflated(layer, _bytes(layer.text))
    for m in BASE64.finditer(layer.text):
        yield from _unbase64(layer.part(m.start(), m.start() + len(m[0].rstrip("="))))
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            run = _replaced(layer.part(*m.span()), OUTSIDE, lambda gap: "", _whole)
            if len(run.text) >= 16:
                yield from _unbase64(run)


def scan_layers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of decoded layers; each sorted by start, kind, end."""
    base = sorted(scan(text))
    every, seen = set(base), set()
    work = [unwrapped(Layer(text, lambda a, b: (a, b)))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.whole())
        if key in seen:
            continue
        seen.add(key)
        for a, k, b in scan(layer.text):
            first, last = layer.locate(a, b)
            every.add((first, k, last))
        work.append(unwrapped(layer))
    return base, sorted(every)


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind in the plain text, a digest of these spans, and all spans as kind:start:end."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, every = scan_layers(text or "")
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_OUT)[1:]))], schema=_OUT)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span, nested layers included, replaced by a mark of its kind; overlapping spans become one."""
    out, at, spans = [], 0, scan_layers(text)[1]
    i = 0
    while i < len(spans):
        a, k, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{KINDS[k]} removed]"]
        at = b
        i += 1
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with redacted text and, if there is such a column, n_chars of the new text; a null text stays null."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t) for t in text.to_pylist()], pa.string())

    out = docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
