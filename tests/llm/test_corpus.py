"""Near-dedup, mixing, neighbours and the pipeline against brute force on small fixtures."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgrove.llm import ann, minhash, mixing, quality, secrets
from sparkgrove.llm.common import row_keys


def brute_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    out = {}
    for s in [tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)]:
        out[s] = out.get(s, 0) + 1
    return out


def brute_links(texts):
    """Pairs of different shingle sets with weighted Jaccard >= 0.8, and near misses that hashing may decide either way."""
    sets = {k: brute_shingles(t) for k, t in texts.items()}
    n = max(2, len(texts))
    df = {}
    for s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    w = {k: {x: tf * (1 + math.log(n / df[x]) / math.log(n)) for x, tf in s.items()} for k, s in sets.items()}
    sure, close = set(), set()
    keys = sorted(k for k in w if w[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            low = sum(min(v, w[b].get(x, 0)) for x, v in w[a].items())
            sim = low / (sum(w[a].values()) + sum(w[b].values()) - low)
            if sim >= 0.8005:
                sure.add((a, b))
            elif sim >= 0.7995:
                close.add((a, b))
    return sure, close


def classes(keys, links):
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts, k = {}, 0
    for group in range(12):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for copy in range(rng.choice([1, 2, 3, 40])):
            t = list(base)
            if copy % 3:
                for _ in range(rng.choice([1, 1, 2, 6])):
                    t[rng.randrange(len(t))] = word()
            texts[k], k = " ".join(t), k + 1
    for t in [None, "", "  \n", "one two", "one two", "one two three", "z " * 3000, "z " * 3000 + "y"]:
        texts[k], k = t, k + 1
    return texts


def test_near_duplicates_match_brute_force(spark):
    texts = planted()
    rows = [(k, t, 5) for k, t in texts.items()] + [(None, "one two", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = minhash.near_duplicates(df.repartition(5)).collect()
    assert len(got) == len(rows)
    sure, close = brute_links(texts)
    mine = {r["doc_id"]: r["class_id"] for r in got}
    assert mine.pop(None) is None
    assert all(mine[a] == mine[b] for a, b in sure)  # no link is lost
    most = classes(texts, sure | close)
    assert all(most[k] == most[c] for k, c in mine.items())  # and none is made up
    assert sum(r["is_first"] for r in got) == len(set(mine.values())) + 1
    assert 15 < len(set(mine.values())) < 60


def test_near_duplicates_around_a_middle_id(spark, monkeypatch):
    """Copies near their base and not near each other, in buckets of several blocks; the base has a middle id."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = {}
    for k in range(160):
        texts[k] = list(base)
        if k != 80:
            for at in rng.sample(range(5, 195), 2 if k % 4 else 1):
                texts[k][at] = word()
    texts = {k: " ".join(t) for k, t in texts.items()}
    sure, close = brute_links(texts)
    assert sum(80 in pair for pair in sure) > 150 and len(sure) < 160 * 159 / 2 * 0.7
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    least = {k: sum(k in pair for pair in sure) for k in texts}
    most = {k: least[k] + sum(k in pair for pair in close) for k in texts}
    for block in (1024, 32):
        monkeypatch.setattr(minhash.block_links, "__defaults__", tuple(block if x == minhash.BLOCK else x for x in minhash.block_links.__defaults__))
        got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
        assert {r["class_id"] for r in got.values()} == {0}
        assert sum(r["n_links"] for r in got.values()) >= 0.995 * sum(least.values()) and all(got[k]["n_links"] <= most[k] for k in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 48, 400).astype(np.uint64)
    wa, wb = rng.random(400) + 0.2, rng.random(400) + 0.2
    k = 1500
    order = np.argsort(h)
    one = lambda w: minhash.samples(np.zeros(400, np.int64), h[order], w[order], 1, k)[0]
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((one(wa) == one(wb)).mean() - true) < 0.05


def test_mix_targets_and_totals(spark):
    assert mixing.targets({}) == {}
    sizes = {"a": 100, "b": 1000, None: 50, "c": 0}
    aim = mixing.targets(sizes)
    # 1725 to share by 5, 2, 1, 5: a stops at 200 and null at 100, c at 0, so b gets the rest
    assert aim["a"] == 200 and aim[None] == 100 and aim["c"] == 0 and abs(aim["b"] - 1425) < 1e-6
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200, 3000])), rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(3000)]
    rows += [(None, "x y", "a", 1), (5, "x y z", "a", 1), (7000, None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    first = mixing.mix(df.repartition(7)).collect()
    again = mixing.mix(df.coalesce(1)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(rows)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
    want = mixing.targets(size)
    for s in want:
        mine = [r for r in first if r["source"] == s]
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert mine[0]["source_size"] == size[s] and abs(mine[0]["target"] - want[s]) < 1e-6
        assert abs(taken - want[s]) <= 0.01 * want[s] + 5
        assert all(0 <= r["copies"] <= 2 for r in mine)
        # the cube balances documents as well as words
        f = want[s] / size[s]
        assert abs(sum(r["copies"] for r in mine) - f * len(mine)) <= 3 + 0.02 * len(mine)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_keeps_ids_and_splits_equal_rows(spark):
    big = 1 << 60
    rows = [(big + i, "w " * (i + 1), "a") for i in range(40)] + [(None, "w", "a")] * 700 + [(7, "w w", "a")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, block=64).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    taken = sum(r["size"] * r["copies"] for r in out)
    assert abs(taken - out[0]["target"]) <= 0.01 * out[0]["target"] + 5
    # equal rows are flown in many blocks, so nearly all of them are taken alike
    share = lambda k: sum(r["copies"] for r in out if r["doc_id"] == k) / 700
    assert abs(share(None) - 1.5) < 0.1 and abs(share(7) - 1.5) < 0.1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5), block=64).collect()))
    named = mixing.mix(df.withColumn("doc_id", F.struct("doc_id", F.lit("x").alias("y"))))
    assert named.count() == len(rows)


def test_aims_equal_targets(spark):
    rng = random.Random(4)
    for sizes in ({}, {"a": 0}, {"a": 1}, {"b": 10, None: 3}, {chr(97 + i): rng.choice([0, 5, 100, 10**6, 10**9]) for i in range(26)}, {f"s{i}": 2**i for i in range(40)}):
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "src string, source_size long, n long")
        want = mixing.targets(sizes)
        got = {r["src"]: r["target"] for r in mixing.aims(df).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_flight_keeps_both_totals():
    rng = random.Random(8)
    size = [float(rng.randrange(1, 5000)) for _ in range(400)]
    chance = [rng.random() for _ in size]
    out = mixing.flight(size, chance, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2
    assert abs(sum(out) - sum(chance)) < 1e-6
    assert abs(sum(s * x for s, x in zip(size, out)) - sum(s * x for s, x in zip(size, chance))) < 1e-3


def brute_nearest(rows, is_query, top=5):
    good = {k: np.array(v, float) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for k in good:
        if is_query(k):
            s = sorted((-float(good[k] @ v / np.linalg.norm(good[k]) / np.linalg.norm(v)), j) for j, v in good.items() if j != k)
            out[k] = [(j, -x) for x, j in s[:top]]
    return out


def test_neighbours_recall_and_odd_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r["vec_id"], list(r["embedding"]) if r["embedding"] is not None else None) for r in table]
    width = len(rows[0][1])
    rows += [(100_000, None), (100_050, [0.0] * width), (100_100, [float("nan")] * width), (100_150, [None] * width), (100_200, []), (None, rows[0][1])]
    rows += [(200_000 + i, rows[3][1]) for i in range(30)]  # copies that crowd one place
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, id int")
    got = ann.nearest(df, lambda key: key % 50 == 0).collect()
    rows = [(k, v and [np.float32(x) if x is not None else None for x in v]) for k, v in rows]
    want = brute_nearest(rows, lambda k: k % 50 == 0)
    mine = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(mine) == set(want)
    hits = sum(len({j for j, _ in mine[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, found in mine.items():
        assert len(found) == 5 and found == sorted(found, key=lambda x: (-round(x[1], 12), x[0]))
        for j, s in found:
            a, b = np.array(exact[q], float), np.array(exact[j], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_neighbours_without_structure(spark, monkeypatch):
    """Independent random vectors, where a graph misses many of the nearest; with several lots of queries and blocks of rows, and equal directions."""
    for name, small in (("LOT_BYTES", 1 << 15), ("ASKED", 7), ("ROWS", 100), ("WAITING", 500)):
        monkeypatch.setattr(ann, name, small, raising=False)
    x = np.random.default_rng(5).standard_normal((3000, 128)).astype(np.float32)
    x[1000:1020] = x[50] * 2.0 ** np.arange(-10, 10)[:, None]  # one direction, equal scores to the last bit
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda k: k % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [j for j, _ in found] for q, found in brute_nearest(rows, lambda k: k % 50 == 0).items()}
    assert got == {**want, 50: [1000, 1001, 1002, 1003, 1004], 1000: [50, 1001, 1002, 1003, 1004]}


def test_neighbours_by_the_graph(spark):
    x = np.random.default_rng(6).standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pick = lambda k: k % 50 == 0
    near, exact = ({(r["query_id"], r["vec_id"]) for r in ann.nearest(df, pick, exact=e).collect()} for e in (False, True))
    assert len(exact) == 40 and len(near & exact) >= 36


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, lambda k: k == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(1), lambda k: k == 0).count() == 0 and ann.nearest(df.limit(0), lambda k: k == 0).count() == 0


def test_neighbours_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(4 if i % 3 else 6)]) for i in range(150)] + [(500, [1.0]), (7, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda k: k % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = {k: v for k, v in sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)}  # of rows that share a key the least vector
    for q in (0, 50, 100):
        same = [(k, v) for k, v in rows.items() if len(v) == len(rows[q])]
        assert got[q] == {j for j, _ in brute_nearest(same, lambda k: k == q)[q]}
    assert 500 not in got


def test_row_keys(spark):
    rows = [(3, "a"), (5, "b"), (5, "c"), (None, "d"), (None, "d"), (-2, "e")]
    keys = row_keys(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()
    assert {(r["doc_id"], r["text"]): r["key"] for r in keys if r["doc_id"] not in (None, 5)} == {(3, "a"): 3, (-2, "e"): -2}
    assert sorted(r["key"] for r in keys) == [-4, -3, -2, 3, 6, 7]
    assert [r["key"] for r in row_keys(spark.createDataFrame(rows[:2], "doc_id long, text string"), "key").orderBy("key").collect()] == [3, 5]


def test_pipeline_dedup_of_rows_without_their_own_id(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = [*base[:100], "changed", *base[101:]]
    other = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(1, base), (None, near), (None, other), (4, other), (9, base[::-1]), (9, [*other[::-1]])]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 5) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    # a row without a doc_id comes first in its class, and different texts that share one all stay
    assert out == {(None, " ".join(near)), (None, " ".join(other)), (9, " ".join(base[::-1])), (9, " ".join(other[::-1]))}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = corpus_pipeline.cut(corpus_pipeline.quality_rules(spark, docs, sf))
    assert rated.columns == docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in rated.collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality.rate(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert kept == {k: t for k, t in whole.items() if verdicts[k]}
    single = corpus_pipeline.cut(corpus_pipeline.near_dedup(spark, rated, sf))
    sure, close = brute_links(kept)
    mine = {r["doc_id"]: r["text"] for r in single.collect()}
    if not close:
        want = classes(kept, sure)
        assert set(mine) == set(want.values())
    clean = corpus_pipeline.cut(corpus_pipeline.secret_scan(spark, single, sf))
    for r in clean.collect():
        spans = secrets.spans_of(mine[r["doc_id"]])
        assert (r["text"] == mine[r["doc_id"]]) == (not spans) and r["n_chars"] == (len(r["text"]) if spans else whole and r["n_chars"])
        assert not any(k != "guess" for k, *_ in secrets.spans_of(r["text"]))
    mixed = corpus_pipeline.cut(corpus_pipeline.mix_sources(spark, clean, sf))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    seen = {}
    for r in mixed.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: c for k, c in copies.items() if c}
    out = corpus_pipeline.encode(spark, mixed, sf).collect()
    assert len(out) == sum(seen.values()) and all(r["round_trip"] for r in out)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    text = "some words that make a sentence of more than twenty words so that the rules on quality let it pass without any trouble at all today"
    rows = [(1, text, "en", "s", 5, 1, 1), (None, text, None, None, None, 1, 1), (None, text, None, None, None, 1, 1), (2, None, None, "s", 0, 1, 1), (3, "", "fr", None, 0, 1, 1), (4, text + " password = hunter2hunter2", "en", "s", 5, 1, 1), (4, text, "en", "s", 5, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int, copies int")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf)
            n = out.count()
            assert (n == 0) == (d is not docs), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    once = corpus_pipeline.near_dedup(spark, docs, sf)
    assert once.where("doc_id is null").count() == 1
    assert corpus_pipeline.secret_scan(spark, docs, sf).where(F.col("text").contains("hunter2")).count() == 0
