"""Personal data, k-means with adaptive bounds, and conversation repair, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from marlstone.llm import conversation_repair as R
from marlstone.llm import drake_kmeans as K
from marlstone.llm import personal_data as P
from marlstone.llm import queries

# ---- personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for at, name, pattern, fits in ((2, "card", r"[0-9]([\x20-]?[0-9])+", lambda d: 12 <= len(d) <= 19 and luhn(d)), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 9 <= len(d) <= 15)):
        found += [(m.start(), at, m.end(), name) for m in re.finditer(pattern, text) if fits(re.sub("[^0-9]", "", m[0]))]
    return sorted(found)


MARKED = [
    "My name is James Smith, I live at 12 Green Oak Street, phone: (212) 555-1234. SSN: 123-45-6789. Mail john [at] foo [dot] org or a@b.co, IBAN GB82WEST12345698765432 ok",
    "Contact Maria Lopez, call 212-555-1234 or +1 (212) 555-1234, host 10.2.3.4",
]
CLEAN = ["Released as version 4.0. The General Public License, section 2, page 212.", "id=212-555-1234x and GB00WEST12345698765432", "Creative Commons is a fine text of 1999 words"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = [*"ab1.2@-_+ ()dot7 0", "é", "😀", "@x.y", "12.34.5.6", "4111 1111 1111 1111", " +1 (555) 123-4567", "\n", "256.1.1.1", "1.2.3.4.5.6.7.8"]
    return ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(700)] + [None, "", "a@b.co " * 1500, "1.2.3.4 5 " * 800]


def test_personal_data(spark, texts):
    long = ["x" * 400_000, "1" * 400_000, "a." * 200_000 + "@" + "b." * 200_000, "+1" * 200_000, "+1 2 " * 60_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a@b.co", "null id"), (0, texts[0], "again")] + [(5000 + i, t, "long") for i, t in enumerate(long)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").repartition(8)
    out = P.personal_digest(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        want, r = base(t or ""), by[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(r["spans"].split(","))
    assert by[None]["spans"] == "email:0:6"
    assert by[5002]["n_email"] == 1 and by[5000]["spans"] == ""
    assert P.personal_digest(df.limit(0)).collect() == []


def test_added_spans(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(2, 8)))
    odd = lambda: r.choice([f"{word()}.{r.randint(10, 99)}@mail.example.com", f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", "10.20.30.40", "4111111111111111", f"{r.randint(10, 99)}", f"{r.randint(1000, 9999)}", f"{r.randint(10**15, 10**16)}", "300.1.2.3", f"x{r.randint(10**9, 10**10)}y"])
    filler = [" ".join(odd() if r.random() < 0.05 else word() for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate([*MARKED, *CLEAN, *filler])), "doc_id long, text string").repartition(4)
    by = {x["doc_id"]: x["spans"] for x in P.personal_digest(df).collect()}
    first = by[0].split(",")
    assert [s.split(":")[0] for s in first] == ["name", "address", "local_phone", "ssn", "obfuscated", "email", "iban"]
    assert [MARKED[0][int(a) : int(b)] for _, a, b in (s.split(":") for s in first)][:3] == ["James Smith", "12 Green Oak Street", "(212) 555-1234"]
    assert [s.split(":")[0] for s in by[1].split(",")] == ["name", "local_phone", "phone", "ip"]
    assert [by[2 + i] for i in range(len(CLEAN))] == [""] * len(CLEAN)
    for i, text in enumerate(filler):
        assert by[2 + len(CLEAN) + i] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in base(text))


def test_label_model_tells_good_labelers_from_bad():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.4
    votes = np.ones((4000, 6), int)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.8, 0.8, 0.5)):
        says = np.where(r.random(4000) < right, truth, ~truth)
        votes[:, j] = np.where(r.random(4000) < 0.2, 1, 2 * says)
    patterns = (votes * 3 ** np.arange(5, -1, -1)).sum(1)
    kinds, shapes, ones = np.full(4000, 4), np.zeros(4000, int), np.ones(4000)
    posterior = P.label_model(kinds, patterns, ones)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    w = P.span_classifier(kinds, patterns, shapes, ones, posterior)
    said = 1 / (1 + np.exp(-P._features(kinds, patterns, shapes) @ w))
    assert ((said > 0.5) == truth).mean() > 0.95
    assert P.label_model(*(np.empty(0, int),) * 2, np.empty(0)).size == 0


def test_personal_data_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    assert "Python" not in P.candidates(df)._jdf.queryExecution().executedPlan().toString()


# ---- k-means


def plain_kmeans(x, seeds, rounds):
    at = seeds.copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        cluster = d.argmin(1)
        if turn < rounds:
            for c in range(len(at)):
                own = x[cluster == c]
                if len(own):
                    at[c] = own.sum(0) // len(own)
    return cluster, d.min(1), at


@pytest.mark.parametrize(("bounds", "spread", "scale"), [(8, 30, 1), (2, 3, 1), (1, 300, 1), (4, 30, 1 << 19)])
def test_drake_equals_full_scans(spark, bounds, spread, scale):
    r = np.random.default_rng(bounds)
    x = (r.integers(-100, 100, size=(12, 6))[r.integers(12, size=900)] + r.integers(-spread, spread + 1, size=(900, 6))) * scale
    x[300:600] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<int>").repartition(3)
    seeds = np.concatenate([x[:10], x[:2]])  # equal seeds: the smaller number wins, the other stays empty
    state, at = K.drake_kmeans(df, seeds, 5, bounds)
    cluster, distance, want = plain_kmeans(x, seeds, 5)
    rows = sorted(state.collect())
    assert [r["cluster"] for r in rows] == cluster.tolist() and [r["distance"] for r in rows] == distance.tolist()
    assert (at == want).all()
    assert np.mean([r["measured"] for r in rows]) < 10  # fewer distances than a scan of all 12


def test_clusters_of_odd_tables(spark):
    good = [[float(i % 7)] * 64 for i in range(10)]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(10, None, "x"), (11, [1.0] * 63, "x"), (12, [float("nan")] * 64, "x"), (13, [float("inf")] + [0.0] * 63, "x"), (14, [None] + [0.0] * 63, "x"), (15, [1e30] * 64, "x"), (None, good[0], "x"), (0, good[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    out = K.cluster_report(K.integer_vectors(df)).collect()
    assert sorted(r["vec_id"] if r["vec_id"] is not None else -1 for r in out) == [-1, 0, *range(10)]
    assert {r["inertia"] for r in out} == {0} and len({r["cluster"] for r in out}) == 7
    assert K.cluster_report(K.integer_vectors(df.limit(0))).collect() == []


# ---- conversation repair


def cheapest(codes):
    """The least (cost, audit) over all edit strings, by dynamic programming on whole strings."""
    best = {(0, 0): (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(3):
            for q in range(4):
                if (i, q) in best:
                    c, a = best[(i, q)]
                    to = (i, (2, 2, 3, 2)[q])
                    best[to] = min(best.get(to, (1 << 60, "")), (c + 3, a + "I"))
        if i == len(codes):
            break
        letter, fault = divmod(codes[i], 3)
        for q in range(4):
            if (i, q) not in best:
                continue
            c, a = best[(i, q)]
            edges = [(4, "D", q)]
            if fault != 1:
                extra = 3 if fault == 2 else 0
                edges.append((3 + extra, "R", (2, 2, 3, 2)[q]))
                to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((letter, q))
                if to is not None:
                    edges.append((extra, "K", to))
            for cost, edit, to in edges:
                best[(i + 1, to)] = min(best.get((i + 1, to), (1 << 60, "")), (c + cost, a + edit))
    return min(best[(len(codes), q)] for q in (0, 3) if (len(codes), q) in best)


def test_repair_is_cheapest_and_least():
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n):
            assert R.repair(bytes(codes)) == cheapest(codes), codes
    r = random.Random(2)
    for _ in range(300):
        codes = [r.randrange(12) for _ in range(r.randint(4, 40))]
        assert R.repair(bytes(codes)) == cheapest(codes)


def test_repair_of_long_conversations():
    r = random.Random(3)
    codes = [r.choice([3, 6, 3, 6, 4, 5, 0, 9]) for _ in range(3000)]
    assert R.repair(bytes(codes)) == cheapest(codes)
    assert R.repair(bytes([3, 6] * 20_000)) == (0, "K" * 40_000)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def expected(rows, convs):
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append(3 * ("sua".find(role[0]) if role and role[0] in "sua" else 3) + {None: 0, 0: 1, 1: 1, 2: 2}[fault])
        letters = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = cheapest(codes)
        lines, i, state = [], 0, 0
        for edit in audit:
            name = "assistant" if state == 2 else "user"
            if edit != "D":
                role = name if edit in "IR" else own[i][2]
                lines.append(f"{role}:{'' if edit == 'I' else own[i][3]}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            i += edit != "I"
        yield conv, (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_over_a_table(spark):
    r = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(400 if conv == 7 else r.randint(0, 9)):
            role = r.choice(["user", "assistant", "system", "tool", None, ""]) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, r.choice([turn, turn, turn + 5, None, 3]), role, r.choice(["Hi.", "ok", "What?", "", " \n", None, f"text {r.randint(0, 3)}!", "ü 😀."])))
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, digest string, step int").repartition(5)
    got = {x["conv_id"]: tuple(x)[1:] for x in R.repair_digests(R.damaged(df)).collect()}
    want = dict(expected(damage(rows), {x[0] for x in rows}))
    assert got == want
    fixed = R.repaired_turns(R.damaged(df)).collect()
    for conv, (*_, digest) in want.items():
        own = sorted((x for x in fixed if x["conv_id"] == conv), key=lambda x: x["position"])
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in own).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in own))
    assert R.repair_digests(R.damaged(df.limit(0))).collect() == []


def test_registered():
    assert {"op11_personal_data", "op12_drake_kmeans", "op13_conversation_repair"} <= set(queries.QUERIES)
