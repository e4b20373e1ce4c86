"""URL filter by rules and a character language-model ratio.

A url that a rule fits takes the longest rule's verdict.  The others are judged by two character models, one of urls that
rules accept and one of those they reject: variable-order Markov chains whose order-k estimate is smoothed by the order below
it.  Their log-likelihood difference, divided by the length, is held against a threshold calibrated for balanced accuracy on
the tenth of ruled urls left out of training.

All counts come from all rows and are exact.  No task holds a model: urls are dealt to batches, and each batch asks the exchange for
the counts of its own sequences.  The driver gets two sums of lengths and two histograms of BINS bins.

Defined results: a null url, and one without `://`, has empty host and path, fits no rule, and is judged by the models (null
as empty text); an empty text and, where rules accept or reject nothing, every other url is allowed; repeated rows are judged
each; a null page_id stays null; no rows, no result rows.  Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ORDERS = 5
END, SYMBOLS = C.U64(256), 257
BATCH_BYTES = 64 << 20
SMOOTH = 4.0
BINS = 400
SPAN = 4.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a domain above it and begins the path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Totals:
    """Symbols in the training urls of each class."""

    allow: int
    block: int


class Urls:
    """A batch's urls as symbols (bytes, then one end) and the keys of all sequences of one to ORDERS symbols that end at each."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        symbols = np.full(int(self.sizes.sum()), END, C.U64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(symbols)) - starts[self.owner]
        symbols[self.place < self.sizes[self.owner] - 1] = np.frombuffer(b"".join(texts), np.uint8)
        gram, keys = C.mix(symbols + C.U64(1)), []
        self.inside = [self.place >= k for k in range(ORDERS)]
        for k in range(ORDERS):
            if k:
                longer = np.zeros(len(symbols), C.U64)
                longer[1:] = C.mix(gram[:-1] * C.U64(0x9E3779B97F4A7C15) + symbols[1:] + C.U64(k << 10))
                gram = longer
            keys.append(gram[self.inside[k]])
        self.keys = np.concatenate(keys) if keys else np.empty(0, C.U64)
        self.order, self.at = C.grouped(self.keys)

    def request(self, allow: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, with their counts in the urls (masks) that train either class."""
        sums = []
        for mask in (allow, block):
            weight = np.concatenate([mask[self.owner[i]] for i in self.inside]).astype(np.uint8)
            sums.append(np.add.reduceat(weight[self.order], self.at, dtype=np.uint32) if len(self.at) else np.empty(0, np.uint32))
        return self.keys[self.order[self.at]], *sums

    def rates(self, counts: list[np.ndarray], totals: Totals) -> np.ndarray:
        """Log-likelihood difference, accepted less rejected, for each symbol of a url on average, given all counts of the keys."""
        difference = np.zeros(len(self.owner))
        cuts = np.cumsum([0, *(int(i.sum()) for i in self.inside)]).tolist()
        for sign, count, total in ((1, counts[0], totals.allow), (-1, counts[1], totals.block)):
            every = C.spread(self.order, self.at, count).astype(float)
            p, context = np.full(len(self.owner), 1 / SYMBOLS), np.full(len(self.owner), float(total))
            for k, inside in enumerate(self.inside):
                met = np.zeros(len(self.owner))
                met[inside] = every[cuts[k] : cuts[k + 1]]
                p[inside] = (met[inside] + SMOOTH * p[inside]) / (context[inside] + SMOOTH)
                context[1:] = met[:-1]
            difference += sign * np.log(p)
        return np.bincount(self.owner, difference, len(self.sizes)) / self.sizes


def best_cut(allow: np.ndarray, block: np.ndarray) -> float:
    """The rate, among bins' edges, that tells two histograms apart with the best balanced accuracy; of equally good ones the middle one."""
    if not allow.sum() or not block.sum():
        return 0.0
    right = np.concatenate([[0], np.cumsum(block)]) / block.sum() + 1 - np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (float(best[len(best) // 2]) / BINS - 0.5) * SPAN


COUNTS = C.summed(np.uint32, np.uint32)
_RATED = "page_id long, host string, path string, rule string, verdict string, held boolean, score double"


def rated_urls(judged: DataFrame, totals: Totals, n: int, fan_bits: int = C.FAN_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, held and, for urls without a rule or held out of training, the models' rate; an empty url has none."""
    names = ["page_id", "host", "path", "rule", "verdict", "held", "url"]
    base = judged.select(C.batch_of(n, "page_id", "url"), *names).repartition(n, "batch")

    def masks(rows: pa.Table) -> list[np.ndarray]:
        held = np.array(rows["held"].to_pylist(), bool)
        return [np.array([v == says for v in rows["verdict"].to_pylist()], bool) & ~held for says in ("allow", "block")]

    def ask(rows: pa.Table) -> pa.Table:
        return C.requests_table(rows["batch"][0].as_py(), n, *Urls(C.texts_of(rows["url"])).request(*masks(rows)), fan_bits=fan_bits)

    def rate(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([rows[c] for c in names[:-1]] + [pa.array([], pa.float64())], names=[*names[:-1], "score"])
        rates = Urls(C.texts_of(rows["url"])).rates(C.joined(told, *COUNTS.answers), totals)
        unjudged = np.array([v is None and bool(u) for v, u in zip(rows["verdict"].to_pylist(), rows["url"].to_pylist(), strict=True)], bool)
        shown = pa.array(rates, mask=~(unjudged | np.array(rows["held"].to_pylist(), bool)))
        return pa.table([*(rows[c] for c in names[:-1]), shown], names=[*names[:-1], "score"])

    answers = C.exchange(base.groupBy("batch").applyInArrow(ask, C.BLOBS), COUNTS, n, fan_bits)
    return base.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(rate, _RATED)


def url_filter(pages: DataFrame, rules=RULES, fan_bits: int = C.FAN_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the models' score where no rule fits (else null)."""
    n = C.n_batches(pages, BATCH_BYTES)
    host, path = url_parts(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.select("*", rule.alias("rule"), verdict.alias("verdict"))
    judged = judged.withColumn("held", F.col("verdict").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(10)) == 0))
    symbols = lambda says: F.coalesce(F.sum(F.when((F.col("verdict") == says) & ~F.col("held"), F.octet_length("url") + 1)), F.lit(0))
    totals = Totals(*judged.agg(symbols("allow"), symbols("block")).first())

    rated = C.materialized(rated_urls(judged, totals, n, fan_bits), "rated-urls")
    place = F.least(F.greatest(F.floor((F.col("score") / SPAN + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    sums = {says: np.zeros(BINS) for says in ("allow", "block")}
    for says, at, count in rated.where("held").groupBy("verdict", place.alias("at")).count().collect():
        sums[says][at] = count
    cut = best_cut(sums["allow"], sums["block"]) if totals.allow and totals.block else -np.inf
    score = F.when(F.col("rule").isNull(), F.col("score"))
    judge = F.when(score.isNull() | (score >= float(cut)), F.lit("allow")).otherwise(F.lit("block"))
    return rated.select("page_id", "host", "path", "rule", F.coalesce("verdict", judge).alias("verdict"), score.alias("score"))
