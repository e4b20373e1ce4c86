"""Token ids of whole texts, by public tokenizers, with each distinct space-separated chunk encoded once.

Both tokenizers cut a text into pieces before merging, and a piece never spans a single space, so chunks can be encoded
alone and their ids joined.  Texts for which that is not certain go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import regex

from .common import HELD, grouped, hash_words, lookup, sort_order, spread

CACHE = 250_000
CHUNKS, PIECES, TEXTS_AT_ONCE = 2_000_000, 200_000, 2_000


class ByteBpe:
    """ids of byte_bpe_50k as little-endian uint32 bytes.

    A chunk is what lies between single spaces, with the space before it.  Runs of two spaces, and special tokens' strings,
    send the whole text to the tokenizer.  ranks is the same vocabulary for a faster encoder of single chunks; without
    it the tokenizer encodes these too.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.one = self._by_tokenizer
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.one = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.inner = _Chunks(lambda chunk: np.array(self.one(" " + chunk), "<u4").tobytes())

    def _by_tokenizer(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.special):
            return np.array(self._by_tokenizer(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.one(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.inner.__getitem__, rest))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        self.inner.room()
        return [self.encode(t) for t in texts]


class _Chunks(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        self[chunk] = ids
        return ids

    def room(self) -> None:
        if len(self) > CACHE:
            self.clear()


class WordBpe:
    """ids of word_bpe_49k as little-endian uint16 bytes.

    The tokenizer normalises (NFC, lower case), splits into letters, single digits and signs, and marks each piece's last
    token.  On characters for which lower-casing and NFC are plain, chunks between white space are encoded by pieces; other
    texts go to the tokenizer whole.  Known chunks are arrays (hash, place in a pool of ids), so a batch's chunks are looked up and
    their ids joined by array operations.
    """

    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD = regex.compile("[^\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]")

    WORD = re.compile(rb"[^\x20\t-\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Known chunks: their hashes, sorted, and where in the pool their ids begin and end."""
        self.keys, self.begin, self.end = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, "<u2")

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        cut = [self.PIECES.findall(c) for c in chunks]
        new = list({p for ps in cut for p in ps}.difference(self.pieces))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.whole.encode(" ".join(some), add_special_tokens=False).ids, "<u2")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and len(ids) == ends[-1]:
                raw, at2 = ids.tobytes(), 0
                for p, e in zip(some, ends.tolist(), strict=True):
                    self.pieces[p] = raw[2 * at2 : 2 * e]
                    at2 = e
            else:
                self.pieces.update((p, self._whole(p)) for p in some)
        return [self.pieces[ps[0]] if len(ps) == 1 else b"".join([self.pieces[p] for p in ps]) for ps in cut]

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        ids = self._ids(chunks)
        ends = np.cumsum([len(x) // 2 for x in ids]) + len(self.pool)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u2")])
        order, self.keys = sort_order(np.concatenate([self.keys, hashes]))
        self.begin = np.concatenate([self.begin, ends - [len(x) // 2 for x in ids]])[order]
        self.end = np.concatenate([self.end, ends])[order]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        text, h, starts, ends = hash_words([t.lower().encode() for t in texts])
        order, at = grouped(h)
        if len(self.keys) > CHUNKS:
            self._forget()
        one_of_each = order[at]
        new = one_of_each[~lookup(h[one_of_each], self.keys)[0]]
        if len(new):
            self._learn(h[new], [self.WORD.match(text, s)[0].decode() for s in starts[new].tolist()])
        known = lookup(h[one_of_each], self.keys)[1]
        begin, sizes = spread(order, at, self.begin[known]), spread(order, at, (self.end - self.begin)[known])
        stops = np.cumsum(sizes)
        ids = self.pool[np.repeat(begin - stops + sizes, sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        cuts = np.concatenate([[0], stops])[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self._whole(t) if self.ODD.search(t) or any(s in t for s in self.special) else None for t in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(plain), TEXTS_AT_ONCE):
            some = plain[at : at + TEXTS_AT_ONCE]
            for i, ids in zip(some, self._encode_plain([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out


_LOADED: dict[tuple, object] = {}
HELD.append(_LOADED)


def loaded(kind, *args):
    """One encoder for each Python worker."""
    if (kind, args) not in _LOADED:
        _LOADED[(kind, args)] = kind(*args)
    return _LOADED[(kind, args)]
