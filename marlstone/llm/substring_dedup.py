"""Substring dedup with fixed-block anchors.

Every document's words are cut into non-overlapping blocks of half a window; these blocks are the index.  Every rolling
block-sized window of every document probes it.  A window that two documents share holds a whole indexed block of either
one, so only windows around a hit can repeat.  Hits are extended in a second exchange over the windows that hold one:
neighbouring windows whose words also start in an earlier document join into maximal exact repeats, which are removed.
Both exchanges send a key once for each batch of documents, so a passage in a third of all rows is no hot key.

Defined results: a null or empty text has no words and loses none; texts shorter than a window lose none; rows that share a
doc_id do not remove each other's words; a null doc_id is the largest of all; a repeat within one document stays; no rows,
no result rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
CHECK_BASE = 0x2545F4914F6CDD1D
LAST = np.iinfo(np.int64).max
KEY_BITS = C.U64(0xFFFFFFFFFFFF0000)  # block keys are a filter only; 48 bits travel cheaper than 64
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _any_of_several(payloads, at):
    """Flags of either bit; the second is set where a key has entries of several documents."""
    sizes = np.diff(np.append(at, len(payloads[0])))
    yield (np.bitwise_or.reduceat(payloads[0], at) | np.where(sizes > 1, 2, 0)).astype(np.uint8)


HITS = C.Question(_any_of_several, (np.uint8,))
EARLIEST = C.Question(lambda payloads, at: [np.minimum.reduceat(payloads[0], at)], (np.uint32, np.int64), checked=True)


class Batch:
    """The windows of a batch of documents: probe() asks for blocks, extend() for the windows around hits, earlier() finds the repeats."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, window // 2
        self.ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        self.texts = C.texts_of(table["text"])
        self.h, self.ends = C.hash_texts(self.texts, lower=False)
        self.owner = np.repeat(self.ids, np.diff(self.ends))

    def probe(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all block-sized windows; a flag says which are indexed blocks, and which several documents hold."""
        self.start = np.flatnonzero(C.starts_within(self.ends, self.block, len(self.h)))
        first = np.repeat(self.ends[:-1], np.diff(self.ends))[self.start]
        keys, doc = C.rolling(self.h, self.block)[self.start] & KEY_BITS, self.owner[self.start]
        self.order, self.at = C.grouped(keys)
        if not len(keys):
            return keys, np.empty(0, np.uint8)
        anchored = np.logical_or.reduceat((((self.start - first) % self.block) == 0)[self.order], self.at)
        doc = doc[self.order]
        several = np.minimum.reduceat(doc, self.at) != np.maximum.reduceat(doc, self.at)
        return keys[self.order][self.at], (anchored + 2 * several).astype(np.uint8)

    def extend(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, checks and first documents of the windows that hold a block which several documents share."""
        seen = np.zeros(len(self.h) + 1, np.int32)
        live = np.zeros(len(self.h), np.int32)
        live[self.start] = C.spread(self.order, self.at, flags) == 3
        np.cumsum(live, out=seen[1:])
        q = np.flatnonzero(C.starts_within(self.ends, self.window, len(self.h)))
        self.q = q[seen[q + self.window - self.block + 1] > seen[q]]
        keys = C.windows_at(C.prefix_sums(self.h), self.q, self.window)
        check = (C.windows_at(C.prefix_sums(self.h, CHECK_BASE), self.q, self.window, CHECK_BASE) >> C.U64(32)).astype(np.uint32)
        self.order, self.at = C.grouped(keys, check)
        if not len(keys):
            return keys, check, np.empty(0, np.int64)
        some = self.order[self.at]
        return keys[some], check[some], np.minimum.reduceat(self.owner[self.q][self.order], self.at)

    def repeated(self, first: np.ndarray) -> np.ndarray:
        """Mask of the words covered by a window that starts in an earlier document."""
        gone = self.q[C.spread(self.order, self.at, first) < self.owner[self.q]]
        covered = np.zeros(len(self.h) + 1, np.int32)
        covered[gone] += 1
        covered[gone + self.window] -= 1
        return np.cumsum(covered[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, fan_bits: int = C.FAN_BITS) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256, and with with_text the kept words as kept (binary, one space between)."""
    base, n = C.with_batches(docs, "doc_id", ["doc_id"])

    def ask(rows: pa.Table, *request) -> pa.Table:
        return C.requests_table(rows["batch"][0].as_py(), n, *request, fan_bits=fan_bits)

    def probe(rows: pa.Table) -> pa.Table:
        return ask(rows, *Batch(rows, window).probe())

    def extend(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return C.BLOBS_ARROW.empty_table()
        batch = Batch(rows, window)
        batch.probe()
        return ask(rows, *batch.extend(*C.joined(told, *HITS.answers)))

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _OUT.empty_table()
        batch, second = Batch(rows, window), told["second"].to_numpy(zero_copy_only=False)
        batch.probe()
        batch.extend(*C.joined(told.filter(pa.array(~second)), *HITS.answers))
        removed = batch.repeated(*C.joined(told.filter(pa.array(second)), *EARLIEST.answers))
        out = []
        for text, a, b in zip(batch.texts, batch.ends[:-1].tolist(), batch.ends[1:].tolist(), strict=True):
            lost, words = removed[a:b], text.split()
            n_lost = int(lost.sum())
            kept = b" ".join(words if not n_lost else [w for w, x in zip(words, lost.tolist(), strict=True) if not x])
            out.append((b - a, n_lost, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.table([rows["doc_id"].cast(pa.int64()).combine_chunks(), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(_OUT)[1:], strict=True))], schema=_OUT)

    hits = C.materialized(C.exchange(base.groupBy("batch").applyInArrow(probe, C.BLOBS), HITS, n, fan_bits), "hits")  # read twice
    early = C.exchange(base.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, C.BLOBS), EARLIEST, n, fan_bits)
    answers = hits.withColumn("second", F.lit(False)).unionAll(early.withColumn("second", F.lit(True)))
    out = base.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    return out if with_text else out.drop("kept")
