"""BPE, language, main text, quality, URL and secret operators against brute force, planted cases and odd inputs."""

import base64
import hashlib
import json
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkgrove.llm import bpe, chat, html, langid, quality, secrets, urls

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n \t", "a", "don't we'll  I'M 12ab3\u00a0\u2028x", "\U0001f600\U0001f468\u200d\U0001f469 caf\u00e9 \u0130\u00df", "x" * 30_000, "ab " * 20_000, "'s 're ''ll '", "\r\n\r\n  z", "\u0301\u0661\u2167\u4e2d\u6587"]


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark):
    rng = random.Random(5)
    letters = "abcdefgh  \n\t'.,;sStTmdDvelrR019\u00e9\u00df\u4e2d\u6587\U0001f600\u00a0\u2009!?-_"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(4, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # n_tokens clashes with an output
    lib = encoder()
    got = bpe.encode(df.repartition(3), PATH, decoded="decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        want = lib.encode_ordinary(t)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == t.encode()
    back = bpe.decode(bpe.encode(df, PATH), PATH, offsets="ends").select("doc_id", "decoded", "ends").collect()
    for r in back:
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "")
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.learn(docs.where(~held))
    out = langid.predict(docs.where(held), model)
    right = out.where("lang is not null and text is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.93
    odd = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(ODD + ["123 !?"])], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 3, len(ODD)))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.learn(docs.limit(0))
    assert [r["lang_pred"] for r in langid.predict(odd, nothing).collect()] == ["und"] * (len(ODD) + 1)


def test_every_language_is_learned(spark):
    names = [f"x{i:02d}" for i in range(70)]
    rows = [(2 * i + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 20, lang) for i, lang in enumerate(names) for k in range(2)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == names


PAGE = """<!doctype html><html><head><title>T</title><style>.x{color:red}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More &amp; more</a></li></ul></nav></header>
<div class="cookie-banner"><p>We use cookies to make this site work for you and for others.</p></div>
<main><article><h1>The  title of
it</h1><p>First &lt;paragraph&gt; with <b>bold</b> words&nbsp;and <a href="x">one link</a> in a sentence that goes on.</p>
<p>Second paragraph of the article, which has a dozen or so words in it.</p><!-- a comment --></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="1">Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><p>I liked this article very much and would read more of it, thank you.</p></section>
<form><label>Mail</label><input type="text"/></form><footer><p>Copyright. All rights reserved by us.</p></footer></body></html>"""


def test_main_text(spark):
    rows = [(0, PAGE, "mine"), (1, None, "mine"), (2, "", "mine"), (3, "plain text without any markup but with a good number of words", "mine"), (4, "<p>unclosed <b", "mine"), (5, "<div>" * 20_000 + "x", "mine"), (0, PAGE, "mine")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), keep_page=False)
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    want = "The title of it\nFirst <paragraph> with bold words and one link in a sentence that goes on.\nSecond paragraph of the article, which has a dozen or so words in it."
    assert sorted(got)[:2] == [(0, want)] * 2
    texts = dict(got)
    assert texts[1] == texts[2] == "" and texts[3].startswith("plain text")
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text_outside_articles_and_after_scripts():
    para = "A paragraph of the main text with a good number of words in it, so that it is long enough to be kept as such. "
    page = f'<body><div><p>{para * 3}</p><p>{para * 2}</p></div><article class="comment"><p>{"I liked this very much and would read more. " * 3}</p></article></body>'
    assert html.main_text(page) == f"{(para * 3).strip()}\n{(para * 2).strip()}"
    for where in ("<head>{}</head><body>{}</body>", "<body>{}{}</body>"):
        page = where.format("<script>for(var i=0;i<n;i++){f(i)}</script>", f"<p>{para * 3}</p>")
        assert html.main_text(page) == (para * 3).strip()


def test_main_text_of_broken_and_odd_pages(spark):
    para = "A paragraph of the main text with a good number of words in it, so that it is long enough to be kept as such."
    p = f"<p>{para}</p>"
    for page, want in (
        (f"<head><meta charset=x>{p}", para),
        (f"<body><button>{p}{p}", f"{para}\n{para}"),
        (f"<article>{p}<p>Short</p><p><a>See also</a></p></article>", f"{para}\nShort"),
        (f"<body>{p}<p><a href=x>Buy this now</a></p>{p}", f"{para}\n{para}"),
        (f"<body>{p}<ul><li><a>one</a></li><li><a>two</a></li></ul></body>", para),
        (f'<div class="layout with-sidebar"><article><h1>T</h1>{p}</article><div class="sidebar">{p}</div></div>', f"T\n{para}"),
        (f'<div class="post tags-enabled"><h1>T</h1>{p}</div><footer>{p}</footer>', f"T\n{para}"),
        (f'<div><h1>T</h1>{p}</div><div id="comments"><h2>C</h2>{p}{p}{p}</div>', f"T\n{para}"),
        (f"<script>if(a<b){{x='it'}}</script>{p}", para),
        (f"{p}<script>never closed {p}", para),
    ):
        assert html.main_text(page) == want, page[:80]
    rows = [(1, f"<body>{p}", "x", "y"), (1, f"<body>{p}", "x", "y")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, page string, __page string"))
    assert [r["text"] for r in out.collect()] == [para] * 2 and out.columns == ["page_id", "html", "page", "__page", "text"]


class Article(HTMLParser):
    """The text of the article element of a page, block by block: written on its own, for pages of the test tables."""

    BLOCKS = set("article h1 h2 h3 h4 p div ul ol li table tr td th section blockquote pre br hr".split())

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_main_text_is_the_article_of_test_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        assert html.main_text(r["html"]) == "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)


def brute_features(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_features(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(100)]
    texts += ["\n".join(rng.choice(["l one", "l two", " ", ""]) for _ in range(12)) for _ in range(30)] + ["a b c d e f g h i " * 5, "#*$ %&| <> \u00e9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_features(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_features(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def test_quality_certified_bounds(spark):
    def exact(n, k, risk, level):
        return k < n and k <= n * risk and sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) <= level

    cases = [(n, k) for n in (1, 50, 600, 1200, 2500) for k in (0, 1, 2, 5, 12)]
    df = spark.createDataFrame(cases, "n long, k long")
    got = {(r["n"], r["k"]): r["c"] for r in df.select("n", "k", quality.certified(F.col("n"), F.col("k"), 0.005, F.lit(0.001)).alias("c")).collect()}
    assert got == {(n, k): exact(n, k, 0.005, 0.001) for n, k in cases}
    assert got[2500, 1] and not got[50, 0]


def test_quality_keeps_good_and_rejects_by_certified_cutoff(spark):
    good = "plain words that say something about a thing or two in a sentence of fair length which goes on for a while "
    bad = " ".join(f"#{i}$" for i in range(40)) + " "
    rows = [(i, good + str(i), "en", "x") for i in range(3000)] + [(10_000 + i, bad + good, "en", "x") for i in range(20)] + [(None, good, None, "x"), (20_000, None, "en", "x"), (20_001, "", "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum string")
    labels = spark.createDataFrame([(i, 1) for i in range(3000)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = quality.rate(docs, labels).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(3000)) and kept[None] and not any(kept[10_000 + i] for i in range(20)) and not kept[20_000]
    assert quality.rate(docs, labels.limit(0)).where("kept").count() == 3021
    assert quality.rate(docs.limit(0), labels).count() == 0


def test_url_rules_and_cascade(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("no scheme/path", "", "", None, "allow"),
        ("http://EXAMPLE.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.example.org/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://a.example.org/fr", "a.example.org", "/fr", "org/", "allow"),
        ("https://notexample.org", "notexample.org", "", None, "allow"),
        ("x://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
        ("x://b.com/de/1", "b.com", "/de/1", "com/de/", "block"),
        ("x://b.com?/de/", "b.com", "", None, "allow"),
        ("x://spam.net/a", "spam.net", "/a", None, "block"),
        ("x://y\n/\n?z", "y\n", "/\n", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, (u, *_) in enumerate(cases)], "page_id long, url string, rule string")
    hosts = df.select(urls.host_of(F.col("url")).alias("key")).distinct()
    out = {r["page_id"]: r for r in urls.judge(df, urls.build(urls.listed_hosts(hosts), hosts)).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, verdict)
    universe = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    listed = universe.where(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    cascade = urls.build(listed, universe)
    wrong = universe.where(cascade.holds(F.col("key")) != (F.pmod(F.xxhash64("key"), F.lit(7)) == 0))
    assert len(cascade.levels) > 1 and wrong.count() == 0
    assert universe.where(urls.build(listed.limit(0), universe).holds(F.col("key"))).count() == 0


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    for k, (p, n) in enumerate((("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)), 1):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= n]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secret_base_spans_and_redaction(spark):
    rng = random.Random(11)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ": ", "'", '"', " ", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "x9_Q", "\u00e9", "\n", "pwd=hunter2horse!"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.find_secrets(df).cache()
    for r in found.collect():
        mine = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]]
        assert [m for m in mine if not m.startswith("guess")] == brute_base(texts[r["doc_id"]])
    for r in secrets.redact(found).collect():
        text, at, out = texts[r["doc_id"]], 0, ""
        if text is None:
            assert r["text"] is None
            continue
        for s in r["spans"]:
            if s["start"] >= at:
                out += text[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_guess_cost_alone_decides():
    for text, value in (("pwd: kT!xQvZ#pLmWr", "kT!xQvZ#pLmWr"), ("DB_PASS=Xk9#mQ2$vLtR", "Xk9#mQ2$vLtR"), ("MYSQL_PASSWORD=p@X9#mQ2$vLtR", "p@X9#mQ2$vLtR"), ("aws_secret_access_key = wJalrXUtnFEMI", "wJalrXUtnFEMI")):
        assert [(k, text[s:e]) for k, s, e, _ in secrets.spans_of(text)] == [("guess", value)]
    assert secrets.spans_of("DB_PASS=passwordpassword") == []


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password") < cost("passw0rd1987") < cost("x9Qv7Lm2Zp0R")
    assert cost("aaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("2019-12-31") < 6
    # the cheapest segmentation of two words costs no more than both with the step between them
    assert cost("dragonmonkey") <= cost("dragon") + cost("monkey") + math.log10(2) + 1e-9


def test_chat_order_matches_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for conv in range(25):
        n = rng.randrange(1, 14)
        deps = {f"c{i}": sorted({f"c{rng.randrange(n + 2)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) for i in range(n)}
        if conv % 3:  # most without cycles
            deps = {k: [d for d in v if int(d[1:]) < int(k[1:])] for k, v in deps.items()}
        known, changed = {}, True
        real = {k: [d for d in v if d in deps] for k, v in deps.items()}
        while changed:
            changed = False
            for k, v in real.items():
                if k not in known and all(d in known for d in v):
                    known[k] = 1 + max((known[d] for d in v), default=-1)
                    changed = True
        want |= {(conv, k): known.get(k) for k in deps}
        rows += [(conv, k, v) for k, v in deps.items()]
    rows += [(99, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)] + [(None, "c0", []), (98, None, [])]
    want |= {(99, f"c{i}"): i for i in range(300)} | {(None, "c0"): None, (98, None): None}
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in chat.ordered(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()}
    assert got == want


def test_chat_messages_are_canonical_json(spark):
    calls = spark.createDataFrame([(1, "a", "f", {"z": 'q"\\\n\u0001', "b": "12"}, []), (1, "b", "g", {"n": None}, ["a"]), (1, "c", "f", {"b": "x"}, ["a"])], "conv_id long, call_id string, name string, args map<string,string>, after array<string>")
    results = spark.createDataFrame([(1, "a", "ok"), (1, "a", "also"), (2, "b", "other"), (1, None, "lost")], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "b", "integer", True, None), ("f", "z", "string", False, None)], chat.SCHEMA_TYPE)
    out = {r["call_id"]: r for r in chat.linked(calls, results, schemas).collect()}
    assert out["a"]["valid"] and out["a"]["n_results"] == 2 and out["a"]["content"] == "also"
    assert out["b"]["errors"] == ["unknown tool"] and out["c"]["errors"] == ["type b"] and out["c"]["depth"] == 1
    want = {"call": {"arguments": {"b": "12", "z": 'q"\\\n\u0001'}, "id": "a", "name": "f"}, "depth": 0, "result": "also", "valid": True}
    assert out["a"]["message"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert chat.linked(calls.limit(0), results, schemas).count() == 0


def test_hash_columns_agree_with_library(spark):
    from sparkgrove.llm import queries

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lib = encoder()
    for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = lib.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_broken_bytes(spark):
    rows = [(0, b"ab\xff\xfecd"), (1, "caf\u00e9".encode()), (2, b"\x80"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    out = {r["doc_id"]: r for r in bpe.encode(df, PATH, decoded="decoded").collect()}
    for k, raw in rows:
        text = (raw or b"").decode("utf-8", "replace")
        assert bytes(out[k]["decoded"]).decode() == text and np.frombuffer(out[k]["ids"], "<u4").tolist() == encoder().encode_ordinary(text)


def test_quality_verdicts_match_brute_force(spark):
    """Steps of every stratum, a minority one and one with too few labels among them, and the verdicts that follow."""
    rng = random.Random(6)
    rows, label = [], []
    for i in range(5200):
        lang = "en" if i < 3000 else "de" if i < 5000 else "fr"
        bad = rng.random() < 0.1
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10**6)) for _ in range(40)]
        if bad or (lang == "de" and rng.random() < 0.0005):
            words = [rng.choice("#$%|") * rng.randrange(3) + w for w in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 8]) for k in range(0, 40, 8)), lang))
        label += [(i, int(not bad))] * rng.randrange(1, 3)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(label, "doc_id long, quality int")
    good = {k for k, q in label if q == 1}

    def rejected_at(text):
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_features(text)
        ratio = {"symbols": n_symbols / n_words, "dup_lines": n_dup / (text.count("\n") + 1), "repeats": n_repeat / n_words, "word_length": word_chars / n_words}
        return next((i for i, (r, c) in enumerate(quality.PATH, 1) if ratio[r] > c), len(quality.PATH) + 1)

    at = {k: rejected_at(t) for k, t, _ in rows}
    step = {}
    for lang in ("en", "de", "fr"):
        mine = [at[k] for k, _, g in rows if g == lang and k in good]
        step[lang] = 0
        while step[lang] < len(quality.PATH):
            k = sum(a <= step[lang] + 1 for a in mine)
            if k > len(mine) * quality.RISK:
                break
            bound = sum(math.comb(len(mine), i) * quality.RISK**i * (1 - quality.RISK) ** (len(mine) - i) for i in range(k + 1))
            if bound > quality.DELTA / 3:
                break
            step[lang] += 1
    assert step["en"] > 0 and step["de"] > 0 and step["fr"] == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(docs, labels).collect()}
    assert kept == {k: at[k] > step[lang] for k, _, lang in rows}
    assert not all(kept.values()) and quality.cutoffs_of(0) == {} and set(quality.cutoffs_of(len(quality.PATH))) == set(quality.RULES)


def test_url_cascade_in_shards(spark):
    universe = spark.range(6_000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    member = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    cascade = urls.build(universe.where(member), universe, max_bits=8_000)
    assert len(cascade.shards) > 1 and all(s.bits <= 8_000 + 64 for s in cascade.shards)
    assert universe.where(cascade.holds(F.col("key")) != member).isEmpty()
    pages = universe.select(F.concat(F.lit("x://"), F.col("key"), F.lit("/a")).alias("url"), F.col("key").alias("listed")).unionByName(spark.createDataFrame([(None, None)], "url string, listed string"))
    out = urls.judge(pages, cascade)
    assert out.where((F.col("verdict") == "block") != F.coalesce(F.pmod(F.xxhash64("host"), F.lit(5)) == 0, F.lit(False))).where("host <> ''").isEmpty() and out.count() == 6_001


def test_guess_cost_matches_all_segmentations():
    """The dynamic programme against a search through every segmentation, with segment costs written anew."""
    ranks = {"cat": 3, "dog": 50, "catdog": 9000, "pass": 7}
    leet = {"@": "a", "4": "a", "3": "e", "0": "o", "1": "i", "5": "s", "$": "s", "!": "i", "7": "t"}
    rows = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
    near = {(a, b) for r in rows for a, b in zip(r, r[1:])} | {(a, b) for r, s in zip(rows, rows[1:]) for a, b in zip(r, s)}

    def kinds(v):
        low = v.lower()
        plain = "".join(leet.get(c, c) for c in low)
        rank = ranks.get(low) or (plain != low and 2 * ranks.get(plain, 0))
        if len(v) >= 3:
            if rank:
                yield math.log10(rank + 1) + (0 if v == low else math.log10(2) if v in (low.title(), low.upper()) else math.log10(2) * len(v) / 2)
            if len(set(v)) == 1:
                yield math.log10(12 * len(v))
            if all((a, b) in near or (b, a) in near for a, b in zip(low, low[1:])):
                yield math.log10(40 * len(v))
            if len({ord(b) - ord(a) for a, b in zip(v, v[1:])}) == 1 and abs(ord(v[1]) - ord(v[0])) == 1:
                yield math.log10(8 * len(v))

    def brute(c):
        one = 1 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
        return one + (math.log10(2) if c.isalpha() and c != c.lower() else 0)

    def least(v, at=0):
        if at == len(v):
            return 0.0
        found = [brute(v[at]) + least(v, at + 1)]
        for end in range(at + 3, len(v) + 1):
            found += [cost + (math.log10(2) if at else 0) + least(v, end) for cost in kinds(v[at:end])]
        return min(found)

    rng = random.Random(9)
    parts = ["cat", "Dog", "c@t", "aaa", "qwe", "abc", "x", "Q", "!", "9", "pass", "d0g", "321"]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        if not re.search(r"(19|20)\d\d", value):
            assert abs(secrets.guess_cost(value, ranks) - least(value)) < 1e-9, value


def test_corpus_ranks_and_clashing_columns(spark):
    texts = ["the the THE cat", "cat dog; a b\u00e4r", None, "", "xx " * 5, "password the"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, __text string, _text string")
    ranks = secrets.corpus_ranks(df)
    assert (ranks["the"], ranks["cat"], ranks["b\u00e4r"]) == (1, 2, 3) and "xx" not in ranks and ranks["password"] == 1
    assert len(secrets.corpus_ranks(df, most=1)) == len(secrets._RANK)
    assert secrets.find_secrets(df, ranks=ranks).columns == [*df.columns, "spans"]
    assert langid.predict(df, langid.learn(df.withColumn("lang", F.lit("en")))).count() == len(texts)
    assert bpe.decode(bpe.encode(df.withColumn("__ids", F.lit(1)), PATH), PATH).count() == len(texts)


def test_chat_arguments_have_their_types(spark):
    args = {"i": "-007", "n": "1.500e+03", "b": "true", "s": "12", "x": "1"}
    calls = spark.createDataFrame([(1, "a", "f", args, []), (1, "b", "f", {"i": "1.5", "n": None, "b": "yes"}, []), (1, "c", "g", {}, [])], "conv_id long, call_id string, name string, args map<string,string>, after array<string>")
    schemas = spark.createDataFrame([("f", "i", "integer", False, None), ("f", "n", "number", False, None), ("f", "b", "boolean", False, None), ("f", "s", "string", False, None)], chat.SCHEMA_TYPE)
    out = {r["call_id"]: r for r in chat.checked(calls, schemas).collect()}
    assert out["a"]["arguments"] == '{"b":true,"i":-7,"n":1.5e3,"s":"12","x":"1"}' and out["a"]["errors"] == ["unexpected x"]
    assert out["b"]["arguments"] == '{"b":"yes","i":"1.5","n":null}' and out["c"]["arguments"] == "{}"
    numbers = ["0", "-0", "-0.0", "00.10", "10", "100", "1e5", "1E-05", "0.0e7", "5e00", "12.340", "-1.0", "0e9"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", chat.json_number(F.col("n")).alias("c"))
    got = {r["n"]: r["c"] for r in df.collect()}
    assert got == {"0": "0", "-0": "0", "-0.0": "0", "00.10": "0.1", "10": "10", "100": "100", "1e5": "1e5", "1E-05": "1e-5", "0.0e7": "0", "5e00": "5", "12.340": "12.34", "-1.0": "-1", "0e9": "0"}
    assert all(json.loads(c) == float(n) for n, c in got.items())


def test_chat_answers_are_whole_and_in_order(spark):
    calls = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "conv_id long, call_id string")
    results = spark.createDataFrame([(1, "a", "z"), (1, "a", None), (1, "a", "b"), (1, "b", "q"), (2, "a", "lost"), (1, None, "lost"), (1, "a", "b")], "conv_id long, call_id string, content string")
    got = sorted((r["call_id"], r["number"], r["content"] or "", r["message"]) for r in chat.answers(calls, results).collect())
    assert [g[:3] for g in got] == [("a", 0, ""), ("a", 1, "b"), ("a", 2, "b"), ("a", 3, "z"), ("b", 0, "q")]
    assert got[0][3] == '{"id":"a","number":0,"result":null}'


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])
