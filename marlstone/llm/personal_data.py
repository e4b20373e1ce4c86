"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation estimates
how reliable they are, and a logistic classifier trained on its posteriors decides.

All work on texts is DataFrame functions; no Python runs on executors.  A kind's spans come from the pieces that split() leaves between
the matches, whose lengths add up to places in blocks of 512, so time is linear in a text but for a small factor.  Patterns are possessive
and anchored at the start of a run, so long runs of one character class cost no backtracking.  Four kinds are certain (email, ip, card,
phone), whose well-formed matches always stay and whose others are dropped but teach the models; the others (mail addresses spelled out, local phones, social security numbers, IBANs, street addresses, names)
are kept where the classifier gives at least `threshold`.

Candidates of a document are written once with their votes (a small table in the shared folder) and read twice: for the counts of
(kind, votes, shape), over all documents, and for the result.  The driver gets those counts, 10 kinds by 3**6 votes by 16 shapes at most;
both fits run on them with priors that weigh as much at every corpus size.

Defined results: null text is empty; an empty text or table gives no spans; null and repeated doc_id give a row each; other columns are
ignored.  Spans of different kinds may overlap; places are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

CONTEXT = 40
BLOCK = 512

# Gazetteers of the labelers.
GIVEN_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Peter Paul Mark Laura Emma Julia Maria Jose Juan Carlos Luis Ana Carmen Pedro Hans Klaus Jürgen Wolfgang Ursula Heike Sabine Pierre Jean Michel Marie Sophie Claire Ahmed Mohammed Fatima Wei Li Yuki Priya Ravi".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Square Place Terrace Way".split()
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split()
TOP_DOMAINS = "com org net edu gov info io co de fr es it uk nl eu ch at be pl tr jp cn in br mx".split()

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_AT, _DOT = r"(?: ?[\[(] ?(?i:at) ?[\])] ?)", r"(?: ?[\[(] ?(?i:dot) ?[\])] ?|\.)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _vote(good, bad) -> Column:
    """1, -1, or 0 to abstain."""
    return F.when(F.coalesce(good, F.lit(False)), 1).when(F.coalesce(bad, F.lit(False)), -1).otherwise(0)


def _luhn(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False)


def _iban(m: Column) -> Column:
    """Whether the remainder by 97 is 1, worked out character by character."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), "")
    step = lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """pattern finds candidates in texts that hold `needs`; form and listed vote on a match, cues on what comes before it."""

    name: str
    pattern: str
    needs: str
    cues: str
    form: object = lambda m: F.lit(1)
    listed: object = lambda m: F.lit(0)
    valid: object = None  # of the certain kinds: whether a match is well formed, and their form's vote


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "e-?mail|mail|contact|write", listed=lambda m: _vote(F.regexp_extract(m, r"([A-Za-z]+)\z", 1).isin(*TOP_DOMAINS), m.rlike(r"\.[0-9]+\z")), valid=lambda m: F.lit(True)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|address|host|server|from", listed=lambda m: _vote(F.lit(False), m.rlike(r"^(?:0|10|127|255|192\.168)\.")), valid=lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}\z")),
    Kind("card", "[0-9](?:[ -]?+[0-9])++", "", "card|visa|mastercard|credit|pay", listed=lambda m: _vote(m.rlike("^[3-6]"), m.rlike("^[^3-6]")), valid=_luhn),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "phone|tel|call|mobile|fax|contact", listed=lambda m: _vote(m.rlike(r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), F.lit(False)), valid=lambda m: F.length(_digits(m)).between(9, 15)),
    Kind("obfuscated", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", "", "e-?mail|mail|contact|write|reach", form=lambda m: _vote(m.rlike(r"(?i)[\[(] ?at ?[\])].+(?:dot|\.)"), F.lit(False)), listed=lambda m: _vote(F.lower(F.regexp_extract(m, r"([A-Za-z]+)\z", 1)).isin(*TOP_DOMAINS), F.lit(True))),
    Kind("local_phone", r"(?<![0-9A-Za-z+().-])(?<![0-9+().-] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])", "", "phone|tel|telephone|call|mobile|fax|contact", form=lambda m: _vote(m.rlike(r"^(?:\(...\) ?...-....|...(.)...\1....)\z"), F.lit(True)), listed=lambda m: _vote(_digits(m).rlike("^[2-9]..[2-9]"), F.lit(True))),
    Kind("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-", "ssn|social security|security number|tax id|taxpayer", form=lambda m: _vote(~m.rlike("^(?:000|666|9)|-00-|-0000"), F.lit(True))),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", "iban|account|bank|konto|compte|cuenta", form=lambda m: _vote(_iban(m), F.lit(True)), listed=lambda m: _vote(F.substring(m, 1, 2).isin(*IBAN_COUNTRIES), F.lit(True))),
    Kind("address", rf"(?<![0-9A-Za-z.,/-])[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}[\p{{L}}'-]{{1,30}} ){{1,4}}(?:{'|'.join(STREETS)})(?![\p{{L}}\p{{N}}_])", "", "address|lives? at|live at|located at|home|residence|ship to|street", form=lambda m: _vote(m.rlike("^[1-9][0-9]{0,4} "), F.lit(False)), listed=lambda m: _vote(m.rlike("(?:Street|Avenue|Road|Lane|Drive|Boulevard)$"), F.lit(False))),
    Kind("name", rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{'|'.join(TITLES)})\.? (?:\p{{Lu}}\p{{Ll}}{{1,20}} )?|(?:{'|'.join(GIVEN_NAMES)}) )\p{{Lu}}\p{{Ll}}{{1,20}}(?![\p{{L}}\p{{N}}_])", "", "name|i am|signed|contact|regards|sincerely|dear|by", form=lambda m: _vote(m.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), F.lit(False)), listed=lambda m: _vote(m.rlike(rf"(?:^|\. | )(?:{'|'.join(GIVEN_NAMES)}) "), F.lit(False))),
)
NAMES = [k.name for k in KINDS]
CERTAIN = [i for i, k in enumerate(KINDS) if k.valid is not None]
LABELERS = ("form", "listed", "cue", "counter", "edges", "company")
_COUNTER = r"(?i)(?:\b(?:version|release|build|isbn|issn|doi|page|pages|section|chapter|figure|table|article|lines?|rfc)\.? ?|[=#/\\$€£])\z"
_OTHERS = r"@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{6}|[0-9]{3}[ -][0-9]{3,4}|\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{12}"


def _votes(kind: Kind, m: Column, before: Column, after: Column) -> list[Column]:
    open_ = before.rlike(r"(?:\A|[\s\"'(<\[:;,])\z") | (before == "")
    shut = after.rlike(r"\A(?:\z|[\s\"')>\]:;,!?]|\.(?:\s|\z))")
    form = kind.form(m) if kind.valid is None else _vote(kind.valid(m), F.lit(True))
    return [form, kind.listed(m), _vote(before.rlike(rf"(?i)(?:\b(?:{kind.cues})\b)[^\p{{L}}\p{{N}}]*(?:\p{{L}}+[^\p{{L}}\p{{N}}]+)?\z"), F.lit(False)), _vote(F.lit(False), before.rlike(_COUNTER)), _vote(open_ & shut, F.lit(True)), _vote(before.rlike(_OTHERS) | after.rlike(_OTHERS), F.lit(False))]


def _shape(m: Column) -> Column:
    """0 to 15: four classes of length by four classes of the share of digits."""
    n = F.greatest(F.length(m), F.lit(1))
    return F.least(F.lit(3), F.floor(n / 8)).cast("int") * 4 + F.least(F.lit(3), F.floor(4 * F.length(_digits(m)) / n)).cast("int")


def _with_kind(df: DataFrame, i: int) -> DataFrame:
    """df with column c<i>: the candidates of KINDS[i] in text as (start, kind, end, votes, shape), or null."""
    kind = KINDS[i]
    found = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
    if kind.needs:
        found = F.when(F.contains("text", F.lit(kind.needs)), found)
    df = df.withColumn("m", found)
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split("text", kind.pattern, -1)))
    g = F.col("g")
    piece = lambda m, j: F.struct(F.length(F.get(g, j)).alias("g"), F.length(m).alias("l"), m.alias("m"), F.substring(F.get(g, j), -CONTEXT, CONTEXT).alias("b"), F.substring(F.get(g, j + 1), 1, CONTEXT).alias("a"))
    df = df.withColumn("p", F.when(g.isNotNull(), F.transform("m", piece))).drop("g", "m")
    n = F.ceil(F.size("p") / BLOCK).cast("int")
    df = df.withColumn("k", F.when(F.size("p") > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice("p", j * BLOCK + 1, BLOCK))))
    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["g"] + x["l"])
    df = df.withColumn("o", F.aggregate(F.transform("k", total), F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t))))
    empty = F.array().cast("array<int>")
    inside = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("s")), lambda acc, x: F.struct((acc["at"] + x["g"] + x["l"]).alias("at"), F.concat(acc["s"], F.array(acc["at"] + x["g"])).alias("s")), lambda acc: acc["s"])
    df = df.withColumn("s", F.flatten(F.zip_with("k", F.slice("o", 1, F.size("k")), inside)))
    placed = F.zip_with("p", "s", lambda p, s: F.struct(p["m"].alias("m"), p["b"].alias("b"), p["a"].alias("a"), s.alias("s"), (s + p["l"]).alias("e")))

    def candidate(x):
        pattern = F.lit(0)
        for v in _votes(kind, x["m"], x["b"], x["a"]):
            pattern = pattern * 3 + v + 1
        return F.struct(x["s"].alias("start"), F.lit(i).alias("kind"), x["e"].alias("end"), pattern.alias("votes"), _shape(x["m"]).alias("shape"))

    return df.withColumn(f"c{i}", F.transform(placed, candidate)).drop("p", "k", "o", "s")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: all candidate spans of a text by start and kind, each with the labelers' votes (base 3) and its shape."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for i in range(len(KINDS)):
        df = _with_kind(df, i)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,votes:int,shape:int>>")
    return df.select("doc_id", F.array_sort(F.concat(*[F.coalesce(F.col(f"c{i}"), none) for i in range(len(KINDS))])).alias("found"))


# ---- the label model and the classifier, over counts of equal candidates ----------------------------------------------

PRIOR_WEIGHT, KIND_WEIGHT, PENALTY = 200.0, 20.0, 0.1
# How often each labeler votes -1, 0 and 1, first on other spans, then on personal data.
_START = np.array(
    [
        [[0.6, 0.2, 0.2], [0.3, 0.5, 0.2], [0.01, 0.94, 0.05], [0.3, 0.69, 0.01], [0.4, 0.2, 0.4], [0.01, 0.84, 0.15]],
        [[0.03, 0.17, 0.8], [0.05, 0.45, 0.5], [0.01, 0.59, 0.4], [0.01, 0.98, 0.01], [0.05, 0.05, 0.9], [0.01, 0.64, 0.35]],
    ]
)
_KIND_PRIOR = np.full(len(KINDS), 0.5)


def _decoded(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], 1).reshape(len(patterns), len(LABELERS))


def label_model(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, steps: int = 500) -> np.ndarray:
    """Posterior of each (kind, votes) by expectation-maximisation: how labelers vote by class, and how often each kind is personal.

    A labeler votes for personal data no less often on it than elsewhere, and against it no more often, or the classes would swap.
    """
    votes, rates, prior = _decoded(patterns), _START.copy(), _KIND_PRIOR.copy()
    posterior = np.zeros(len(kinds))
    for _ in range(steps):
        logs = np.stack([np.log(rates[y][np.arange(len(LABELERS)), votes]).sum(1) for y in (0, 1)])
        odds = np.log(prior[kinds] / (1 - prior[kinds])) + logs[1] - logs[0]
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for y, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            seen = np.stack([np.bincount(votes[:, j], weight, 3) for j in range(len(LABELERS))])
            rates[y] = (seen + PRIOR_WEIGHT * _START[y]) / (weight.sum() + PRIOR_WEIGHT)
        rates[1, :, 2], rates[1, :, 0] = np.maximum(rates[1, :, 2], rates[0, :, 2]), np.minimum(rates[1, :, 0], rates[0, :, 0])
        rates /= rates.sum(2, keepdims=True)
        held = np.bincount(kinds, counts * posterior, len(KINDS)) + KIND_WEIGHT * _KIND_PRIOR
        prior = np.clip(held / (np.bincount(kinds, counts, len(KINDS)) + KIND_WEIGHT), 0.001, 0.999)
        if len(kinds) == 0 or np.abs(posterior - before).max() < 1e-9:
            break
    return posterior


def _features(kinds: np.ndarray, patterns: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    votes = _decoded(patterns)
    sides = [(votes == v).astype(float) for v in (0, 2)]
    return np.concatenate([np.eye(len(KINDS))[kinds], *sides, np.eye(4)[shapes // 4], np.eye(4)[shapes % 4]], 1)


def span_classifier(kinds: np.ndarray, patterns: np.ndarray, shapes: np.ndarray, counts: np.ndarray, posterior: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a penalised logistic regression on the posteriors, by Newton's method: kinds, votes against, votes for, length, digits."""
    x = _features(kinds, patterns, shapes)
    w = np.zeros(len(KINDS) + 2 * len(LABELERS) + 8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (counts * (p - posterior)) + PENALTY * w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), slope)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(table: DataFrame) -> np.ndarray:
    """The classifier's weights from the candidates of all documents."""
    c = F.col("c")
    rows = table.select(F.explode("found").alias("c")).groupBy(c["kind"].alias("kind"), c["votes"].alias("votes"), c["shape"].alias("shape")).count().orderBy("kind", "votes", "shape").collect()
    kinds, patterns, shapes = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    counts = np.array([r[3] for r in rows], float)
    return span_classifier(kinds, patterns, shapes, counts, label_model(kinds, patterns, counts))


def _probability(weights: np.ndarray, c: Column) -> Column:
    k, n = len(KINDS), len(LABELERS)
    table = lambda values: F.array(*[F.lit(float(v)) for v in values])
    z = F.get(table(weights[:k]), c["kind"])
    for j in range(n):
        vote = (F.floor(c["votes"] / 3 ** (n - 1 - j)) % 3).cast("int")
        z = z + F.get(table([weights[k + j], 0, weights[k + n + j]]), vote)
    length, digits = weights[k + 2 * n : k + 2 * n + 4], weights[k + 2 * n + 4 :]
    return 1 / (1 + F.exp(-(z + F.get(table(length), F.floor(c["shape"] / 4).cast("int")) + F.get(table(digits), c["shape"] % 4))))


def personal_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end, certain, probability), by start and then by kind as in KINDS."""
    table = materialized(candidates(docs), "personal-data")
    weights = train(table)
    named = F.array(*[F.lit(n) for n in NAMES])
    certain = lambda x: x["kind"].isin(*CERTAIN)
    formed = lambda x: F.floor(x["votes"] / 3 ** (len(LABELERS) - 1)) == 2
    real = F.filter("found", lambda x: ~certain(x) | formed(x))
    judged = F.transform(real, lambda x: F.struct(F.get(named, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), certain(x).alias("certain"), _probability(weights, x).alias("probability")))
    return table.select("doc_id", F.filter(judged, lambda x: x["certain"] | (x["probability"] >= threshold)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def personal_digest(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the count of each certain kind, base_sha256 and spans as text."""
    found = personal_spans(docs, threshold)

    def count(name):
        return F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    base = F.sha2(span_text(F.filter("spans", lambda x: x["certain"])), 256)
    return found.select("doc_id", *[count(NAMES[i]) for i in CERTAIN], base.alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
