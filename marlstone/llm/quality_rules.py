"""Quality rules by weak supervision.

Ten rules vote good or bad on each text or abstain.  The corpus is reduced to counts of vote patterns (3**10 at most, however
large it is); expectation-maximisation over these counts estimates how often each rule is right about good and about bad
texts, and a text is kept by its posterior probability of being good, not by passing every rule.  A small set of base
conditions (under 50 words, or over half of its words in repeated three-word windows) rejects outright.

Defined results: a null or empty text has no words, all counts are 0 and base_failed is true; a null doc_id stays null;
repeated rows are judged alike, each on its own row; no rows, no result rows.  Other columns of the input are ignored by
quality_rules() and passed on untouched by keep_quality(), whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

GOOD, BAD, ABSTAIN = 0, 1, 2
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeats", "letters", "variety", "line_ends", "capitals", "bare_signs")
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD, PSEUDO_COUNT = 0.9, 0.99, 0.4, 200.0
STEPS, TOLERANCE = 1000, 1e-7
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
INNER = bytes(range(128, 192))
BARE = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"
_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("pattern", pa.int32())])


def _vote(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def measure(text: bytes) -> tuple[int, int, int, int, int, bool, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the votes as one number of base 3."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, SPACES + INNER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    failed = n < 50 or 100 * repeated > 50 * n
    n1, solid = max(1, n), max(1, len(text.translate(None, SPACES)))
    mean, symbol_rate, dup_rate, repeat_rate = chars / n1, symbols / n1, dup_lines / max(1, len(lines)), repeated / n1
    letters = (len(text) - len(text.translate(None, LETTERS))) / solid
    capitals = (len(text) - len(text.translate(None, CAPITALS))) / solid
    variety = len(set(words)) / n1
    ends = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines) / max(1, len(lines))
    bare = sum(map(BARE.__contains__, words)) / n1
    votes = (
        _vote(n, n >= 80, n < 50),
        _vote(mean, 3.5 <= mean <= 8, mean < 2.5 or mean > 11),
        _vote(symbol_rate, symbol_rate <= 0.02, symbol_rate > 0.1),
        _vote(dup_rate, dup_rate == 0 and len(lines) > 2, dup_rate > 0.3),
        _vote(repeat_rate, repeat_rate <= 0.1, repeat_rate > 0.3),
        _vote(letters, letters >= 0.9, letters < 0.75),
        _vote(variety, variety >= 0.3, variety < 0.12),
        _vote(ends, ends >= 0.5, ends < 0.05),
        _vote(capitals, capitals <= 0.12, capitals > 0.3),
        _vote(bare, bare <= 0.02, bare > 0.12),
    )
    pattern = 0
    for v in votes:
        pattern = pattern * 3 + v
    return n, chars, symbols, dup_lines, repeated, failed, pattern


def quality_features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [measure(t) for t in texts_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *(pa.array([x[i] for x in found], f.type) for i, f in enumerate(list(_ARROW)[1:]))], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _FEATURES)


@dataclass(frozen=True)
class RuleModel:
    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        votes = np.stack([pattern // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], 1)
        g, b = np.array(self.right_on_good), np.array(self.right_on_bad)
        good = np.where(votes == GOOD, np.log(g), np.where(votes == BAD, np.log(1 - g), 0)).sum(1) + np.log(self.prior)
        bad = np.where(votes == GOOD, np.log(1 - b), np.where(votes == BAD, np.log(b), 0)).sum(1) + np.log(1 - self.prior)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> RuleModel:
    """EM over weighted vote patterns until no rate moves by TOLERANCE, with priors that weigh as much as PSEUDO_COUNT texts, whatever the corpus' size.

    A rule's rate of faulting bad texts stays above its rate of faulting good ones, or the classes would swap.
    """
    votes = np.stack([patterns // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], 1) if len(patterns) else np.empty((0, len(RULES)), int)
    rates = np.array([PRIOR, *(RIGHT_ON_GOOD,) * len(RULES), *(RIGHT_ON_BAD,) * len(RULES)])
    model = RuleModel(PRIOR, (RIGHT_ON_GOOD,) * len(RULES), (RIGHT_ON_BAD,) * len(RULES))
    for _ in range(steps):
        p = model.posterior(patterns) * counts
        q = counts - p

        def right(w, vote, mean, heavy):
            return ((w[:, None] * (votes == vote)).sum(0) + mean * heavy) / ((w[:, None] * (votes != ABSTAIN)).sum(0) + heavy)

        on_good = np.clip(right(p, GOOD, RIGHT_ON_GOOD, PSEUDO_COUNT * PRIOR), 0.5, 0.999)
        on_bad = np.clip(right(q, BAD, RIGHT_ON_BAD, PSEUDO_COUNT * (1 - PRIOR)), np.minimum(1.05 - on_good, 0.999), 0.999)
        model = RuleModel(float((p.sum() + PRIOR * PSEUDO_COUNT) / (counts.sum() + PSEUDO_COUNT)), tuple(map(float, on_good)), tuple(map(float, on_bad)))
        before, rates = rates, np.array([model.prior, *model.right_on_good, *model.right_on_bad])
        if np.abs(rates - before).max() < TOLERANCE:
            break
    return model


def fit_rules(features: DataFrame) -> RuleModel:
    """The driver gets one count for each vote pattern: 3**10 rows at most."""
    rows = features.groupBy("pattern").count().orderBy("pattern").collect()
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, votes' pattern, posterior and kept (posterior over threshold, base conditions met)."""
    features = quality_features(docs)
    model = fit_rules(features)
    every = model.posterior(np.arange(3 ** len(RULES)))

    def judge(batches):
        for b in batches:
            p = every[b["pattern"].to_numpy()]
            kept = (p > threshold) & ~b["base_failed"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(kept)], names=[*b.schema.names, "posterior", "kept"])

    return features.mapInArrow(judge, _FEATURES + ", posterior double, kept boolean")


def keep_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns."""
    every = fit_rules(quality_features(docs)).posterior(np.arange(3 ** len(RULES)))

    def keep(text: pa.Array) -> pa.Array:
        return pa.array([not m[5] and bool(every[m[6]] > threshold) for m in map(measure, texts_of(text))], pa.bool_())

    return docs.filter(F.arrow_udf(keep, "boolean")(F.col("text")))
