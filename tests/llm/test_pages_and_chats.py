"""URL filter, chat format and pipeline."""

import hashlib
import math
import random
from collections import Counter

import pytest

from marlstone.llm import chat_format, queries, url_filter


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_filter(spark):
    r = random.Random(1)
    urls = [f"https://{r.choice(['www.', 'm.', ''])}{r.choice(['good', 'fine', 'spam-casino', 'win-casino'])}.{r.choice(['org', 'com', 'net', 'example.org', 'EXAMPLE.org'])}/{r.choice(['fr', 'de', 'es', 'en'])}/{r.randint(0, 200)}{r.choice(['', '?q=/x', '#t'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://org", "http://x.org", "http://x.org?a", "http://notorg/", "ftp://A.ORG/x://y", "http://example.org/es/", "http://org.example.com/fr/\nline", "http://x.org#/p", urls[0]]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[1], "h", "p")], "page_id long, url string, html string, host string")
    out = url_filter.url_filter(df).collect()
    assert len(out) == len(urls) + 1
    for x in out:
        host, path, rule, verdict = brute(urls[x["page_id"]] if x["page_id"] is not None else urls[1])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule), urls[x["page_id"] or 1]
        assert x["verdict"] == verdict or verdict is None
    spark_held = {x["url"] for x in df.where("url is not null and pmod(xxhash64(url), 10) = 0").collect()}
    scores, cut = plain_models([u for u in [*urls, urls[1]]], spark_held)
    for fan_bits in (8, 1):
        for x in url_filter.url_filter(df, fan_bits=fan_bits).collect():
            url = (urls[x["page_id"]] if x["page_id"] is not None else urls[1]) or ""
            if x["rule"] is None and url:
                assert x["score"] == pytest.approx(scores(url), abs=1e-9)
                assert x["verdict"] == ("allow" if x["score"] >= cut else "block")
            else:
                assert x["score"] is None and (x["rule"] or x["verdict"] == "allow")
    assert url_filter.url_filter(df.limit(0)).collect() == []


def plain_models(urls, held):
    """The two models by dictionaries: a function url -> rate, and the cut."""
    models = {}
    for says in ("allow", "block"):
        c = Counter()
        for u in urls:
            if u and brute(u)[3] == says and u not in held:
                w = [*u.encode(), 256]
                c.update(tuple(w[a : a + k]) for k in range(1, 6) for a in range(len(w) - k + 1))
                c[()] += len(w)
        models[says] = c

    def log_p(c, w):
        out = 0.0
        for i, x in enumerate(w):
            p = 1 / 257
            for k in range(min(i, 4) + 1):
                context = tuple(w[i - k : i])
                p = (c[(*context, x)] + 4 * p) / (c[context] + 4)
            out += math.log(p)
        return out

    def rate(u):
        w = [*u.encode(), 256]
        return (log_p(models["allow"], w) - log_p(models["block"], w)) / len(w)

    bins = {says: [0] * 400 for says in models}
    for u in urls:
        if u and brute(u)[3] and u in held:
            bins[brute(u)[3]][min(399, max(0, math.floor((rate(u) / 4 + 0.5) * 400)))] += 1
    a, b = bins["allow"], bins["block"]
    if not sum(models["allow"].values()) or not sum(models["block"].values()):
        return rate, -math.inf
    if not sum(a) or not sum(b):
        return rate, 0.0
    right = [sum(b[:j]) / sum(b) + 1 - sum(a[:j]) / sum(a) for j in range(401)]
    best = [j for j, x in enumerate(right) if x >= max(right) - 1e-12]
    return rate, (best[len(best) // 2] / 400 - 0.5) * 4


@pytest.mark.parametrize("kinds", [["org/p"], ["com/de/p"], [], ["org/p", "com/de/p"]])
def test_url_classes_may_be_empty(spark, kinds):
    """Where rules accept or reject nothing all other urls are allowed; rows sorted by class are no harm."""
    ruled = [(i, f"http://x{i}.{k}") for k in kinds for i in range(60)]
    other = [(1000 + i, f"http://y{i}.net/q") for i in range(40)]
    out = url_filter.url_filter(spark.createDataFrame(ruled + other, "page_id long, url string").repartitionByRange(4, "url")).collect()
    assert len(out) == len(ruled) + 40
    assert len(kinds) == 2 or {x["verdict"] for x in out if x["page_id"] >= 1000} == {"allow"}


def test_url_models_tell_classes_apart(spark):
    r = random.Random(2)
    words = {"allow": ["garden", "recipe", "history"], "block": ["casino", "xxxpills", "jackpot"]}
    ruled = [(i, f"http://{r.choice(words[c])}{r.randint(0, 99)}." + (f"org/{r.choice(words[c])}" if c == "allow" else f"com/de/{r.choice(words[c])}")) for i, c in enumerate(["allow", "block"] * 150)]
    probe = [(1000 + i, f"http://{r.choice(words[c])}{r.randint(0, 99)}.net/{r.choice(words[c])}") for i, c in enumerate(["allow", "block"] * 40)]
    out = {x["page_id"]: x["verdict"] for x in url_filter.url_filter(spark.createDataFrame(ruled + probe, "page_id long, url string")).collect()}
    right = sum(out[1000 + i] == c for i, c in enumerate(["allow", "block"] * 40))
    assert right >= 72


DECOY = r"\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", DECOY), (1, 1, "assistant", DECOY), (1, 1, "assistant", None), (2, 5, "assistant", "b\\\\l<\\n"), (2, 4, "system", "</turn>\n<turn:user>\nx"), (3, None, None, "no turn"), (3, 0, "odd>\n<role\\", ""), (None, 0, "user", "lost"), (4, 0, "assistant", "é" * 5000), (4, 0, "assistant", "é" * 5000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, piece string, tokens string")
    got = {x["conv_id"]: x for x in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        x = got[c]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(groups)
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).collect() == []


def test_content_parts():
    parts = [{"type": "text", "text": "see <this>"}, {"type": "image", "ref": "a.png", "width": 1024, "height": 600}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": None, "text": "end now"}]
    piece, attachments, tokens, start, end = chat_format.format_turn("assistant", parts)
    assert piece[start:end] == "see \\lthis><image:.1><audio:.2><document:.3>end now"
    assert [(a[0], a[1], a[2]) for a in attachments] == [(1, "image", "a.png"), (2, "audio", "b.wav"), (3, "document", "c.pdf")]
    assert attachments[0][3] == 85 + 4 * 170 and attachments[1][3] == 63 and tokens == sum(a[3] for a in attachments)
    assert chat_format.format_turn("assistant", parts, count=lambda t: len(t.split()))[2] == tokens + 4
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])


def test_typed_parts_column(spark):
    schema = f"conv_id long, turn long, role string, text string, parts {chat_format.PARTS}"
    part = ("image", None, "a.png", 10, 10, None, None)
    df = spark.createDataFrame([(1, 0, "user", None, [part, ("text", "hi", None, None, None, None, None)]), (1, 1, "assistant", "plain", None)], schema)
    out = chat_format.format_turns(df).orderBy("turn").collect()
    assert out[0]["attachments"][0]["ref"] == "a.png" and out[0]["piece"] == "<turn:user>\n<image:0.1>hi\n</turn>\n" and out[1]["attachments"] == []


def test_other_parts_column_is_ignored(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", [1])], "conv_id long, turn long, role string, text string, parts array<int>")
    assert chat_format.format_turns(df).first()["piece"] == "<turn:user>\nhi\n</turn>\n"


def test_addresses_become_parts_and_come_back(spark, tmp_path):
    import duckdb

    texts = ["see https://a.b/c.PNG, then http://x.y/<z> and\nhttps://q.r/s.mp3", "<image:0.1> is no placeholder https://e.f", "http:// https://é.ü/ö.wav", None, "no address"]
    rows = [(i % 2, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    pieces = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer=queries.byte_bpe()).collect()
    for (_, n, role, t), x in zip(rows, sorted(pieces, key=lambda x: x["turn"]), strict=True):
        assert chat_format.read_turns(x["piece"], [a["ref"] for a in x["attachments"]]) == [(role, t or "")]
        assert "http" not in x["piece"] or "http:// " in (t or "")
        assert x["tokens"] >= sum(a["tokens"] for a in x["attachments"])
    assert [a["kind"] for a in min(pieces, key=lambda x: x["turn"])["attachments"]] == ["document", "document", "audio"]
    got = queries.op5_chat_format(spark, str(tmp_path))
    names = sorted(got.columns)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(queries.ORACLE["op5_chat_format"])
    at = [want.columns.index(n) for n in names]
    assert Counter(tuple(x[n] for n in names) for x in got.collect()) == Counter(tuple(x[i] for i in at) for x in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    v = ["w%s" % "".join(r.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    text = lambda n: ". ".join(" ".join(r.choice(v) for _ in range(8)) for _ in range(n)) + "."
    item = " ".join(r.choice(v) for _ in range(30))
    twin = text(20)
    rows = [(i, text(15)) for i in range(40)] + [(50, twin), (51, twin), (52, twin.replace(twin.split()[3], "changed", 1)), (60, f"{text(5)} {item} {text(5)}"), (61, f"{text(10)} password=abcdefgh1 {text(3)}"), (70, "short"), (71, None), (72, "")]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = {x["doc_id"]: x for x in docs.collect()}
    assert set(left) == {*range(40), 50, 61}
    assert "[assign removed]" in left[61]["text"] and left[61]["n_chars"] == len(left[61]["text"])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {x["doc_id"] for x in packed} == set(left)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
