"""Vector search and URL filters against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import ball_tree, url_filters


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        v = rng.normal(size=8) + (i % 5)
        data.append((i, [float(x) for x in v], "extra"))
    data += [(600, None, None), (601, [], None), (602, [1.0, None] + [0.0] * 6, None), (603, [math.nan] * 8, None), (604, [math.inf] + [0.0] * 7, None), (None, [1.0] * 8, None)]
    data += [data[7], data[7], (700, [1.0, 2.0], None), (650, [0.5, 0.5], None), (706, data[11][1], None)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    good = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v, _ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        scored = sorted(((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    for shard_rows, query_rows in ((8192, 2048), (100, 5)):
        got = ball_tree.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows)
        assert {tuple(r) for r in got.collect()} == want
    assert ball_tree.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ball_tree.top_k(frame, F.lit(False)).count() == 0


def test_one_tree_per_shard(spark, tmp_path):
    """Shards hold near vectors, even where a third are equal; each is built once and bounds all its inner products."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 3000
    data = np.concatenate([(centres[k % 12] + rng.normal(size=6) * 50).astype(np.int64)[None] for k in range(800)] + [np.full((400, 6), 7)])
    frame = spark.createDataFrame([(k, v.tolist(), 6, 1) for k, v in enumerate(data)], "vec_id long, v array<long>, dim int, copies long")
    sharded = ball_tree._sharded(frame, 100, 600)
    assert sharded.groupBy("shard").count().agg(F.max("count")).first()[0] < 200
    roots = ball_tree.write_trees(sharded, f"file://{tmp_path}/trees").collect()
    assert len(roots) == len({r["shard"] for r in roots}) == sharded.select("shard").distinct().count() == len(list((tmp_path / "trees").iterdir()))
    seen, radii = [], []
    for r in roots:
        tree, vectors, ids, copies = ball_tree.read_tree(r["path"])
        assert (vectors == data[ids]).all() and (copies == 1).all()
        bound = ball_tree.upper_bounds(data[:50], np.array([r["centre"]]), np.array([r["radius"]]))[:, 0]
        assert (bound >= (data[:50] @ vectors.T).max(axis=1)).all()
        seen += ids.tolist()
        radii.append(r["radius"])
    assert sorted(seen) == list(range(len(data))) and np.median(radii) < 0.8 * np.sqrt(((data - data.mean(axis=0)) ** 2).sum(axis=1).max())


def test_tree_opens_few_nodes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4000
    data = (np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    tree = ball_tree.build(data, leaf=25)
    q = data[:1]
    bounds = q.astype(float) @ tree.centres.T + np.sqrt((q.astype(float) ** 2).sum()) * tree.radii
    kth = np.sort(data @ q[0])[-11]
    leaves = [n for n in range(len(tree.first)) if tree.left[n] < 0]
    assert sum(bounds[0, n] >= kth for n in leaves) < len(leaves) / 2


URLS = [
    None, "", "no scheme", "https://", "://x/y", "HTTP://WWW.Foo.NET/en/1?x=1#y", "http://example.net/en/2", "http://a.example.net/en", "http://badexample.net/en/",
    "https://b.example.com/de/3", "https://example.com?de/", "https://x.org/fr/", "https://x.org/frx", "ftp://org/fr/9", "http://h#/net/", "http://ÄB.Net/",
    "http://net", "http://casino-win.example.com/en/" + "9" * 5000, "http://x://y.net/en/",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1])) if fits else None
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_and_parts(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    model = url_filters.UrlModel(None, None, None, 0.0)
    for row in url_filters.judge(frame, model).collect():
        host, path, rule, verdict = expected(URLS[row["page_id"]])
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict or "allow"), URLS[row["page_id"]]
    assert url_filters.judge(frame.limit(0), model).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghilmnoprst") for _ in range(rng.randint(4, 9)))

    def made(bad):
        if bad:
            return f"http://{word()}-{rng.randint(10, 999)}-{word()}.example.{rng.choice(['xyz', 'top'])}/{word()}?a={rng.randint(1, 99)}&b={word()}&c=1"
        return f"https://www.{word()}.example.{rng.choice(['com', 'org'])}/{word()}/{word()}.html"

    rows = [(made(k % 2), k % 2) for k in range(800)]
    frame = spark.createDataFrame(rows[:600], "url string, label int")
    model = url_filters.train(frame, rounds=5)
    held = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows[600:])], "page_id long, url string, y int")
    judged = model.predict(url_filters.lexical(held, "url")).select("y", "blocked").collect()
    assert sum(r["y"] == r["blocked"] for r in judged) > 0.95 * len(judged)
    assert url_filters.train(frame.where("label = 1")).constant == 1.0
    assert url_filters.train(frame.limit(0)).constant == 0.0


def test_seed_labels(spark):
    frame = spark.createDataFrame([("http://free-bets.example.com/",), ("http://alphabets.example.com/",), (None,), ("x",)], "url string")
    assert sorted(map(tuple, url_filters.seed_labels(frame).collect())) == [("http://alphabets.example.com/", 0), ("http://free-bets.example.com/", 1)]


def test_held_out_hosts(spark):
    """Hosts that no tree has seen are judged by what their URLs look like; a label does not show in its own features."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choice("aehinorst") for _ in range(rng.randint(4, 8)))
    bad = [f"{rng.choice(('www', 'm', 'blog'))}.{a}-{b}.example.{t}" for a, b in (("casino", "win"), ("free", "bets"), ("cheap", "pills"), ("spam", "farm"), ("adult", "x"), ("big", "poker"), ("lottery", "now"), ("payday", "fast")) for t in ("com", "net")]
    good = [f"{rng.choice(('', 'www.', 'm.', 'blog.'))}{name()}.example.{rng.choice(('com', 'net', 'org'))}" for _ in range(120)]
    urls = [(f"http{rng.choice(('', 's'))}://{rng.choice(good if rng.random() < 0.9 else bad)}/{rng.choice(('en', 'de'))}/{rng.randint(1, 9999)}{rng.choice(('', '/', '.html', '?page=2&ref=x', '#top'))}",) for _ in range(3000)]
    labelled = url_filters.seed_labels(spark.createDataFrame(urls, "url string"))
    found = url_filters.held_out(labelled, rounds=5, depth=3).agg(*[F.sum(c).alias(c) for c in ("caught", "missed", "wrong", "right")]).first()
    assert sum(found) == 3000
    assert found["caught"] / (found["caught"] + found["missed"]) >= 0.9 and found["caught"] / (found["caught"] + found["wrong"]) >= 0.9


def test_trees_know_words_and_not_hyphens(spark):
    """Good hosts with hyphens and bad ones without: parts of all hosts are judged by trees that saw none of them."""
    rng = random.Random(2)
    good = [f"{a}{rng.choice(('-', '', '.'))}{b}.example.{t}" for a in ("coca", "garden", "night", "red", "world", "nord") for b in ("cola", "school", "market", "river", "press") for t in ("com", "org")]
    bad = [f"{a}{rng.choice(('', '-'))}{b}.example.{t}" for a in ("casino", "poker", "lottery", "viagra") for b in ("night", "red", "world", "club", "press") for t in ("com", "org")]
    named = spark.createDataFrame([(f"https://{h}/en/{k}", int(h in bad)) for k, h in enumerate(good + bad)], "url string, label int")
    known = url_filters.one_per_host(named.unionByName(url_filters.seed_hosts(spark)))
    options = {"rounds": 10, "feature_share": 0.3}
    found = url_filters.held_out(known, **options).agg(*[F.sum(c).alias(c) for c in ("caught", "missed", "wrong", "right")]).first()
    assert found["caught"] / (found["caught"] + found["missed"]) >= 0.9 and found["caught"] / (found["caught"] + found["wrong"]) >= 0.9
    model = url_filters.train(known, per_host=True, most_share=0.6, **options)
    assert model.trees is not None and max(model.importance().values()) <= 0.6 and abs(sum(model.importance().values()) - 1) < 1e-6
    unseen = {"www.coca-cola.com": 0.0, "my-school.edu": 0.0, "de-academic.com": 0.0, "casino.example.com": 1.0, "xxxvideo.example.com": 1.0, "www.bets.example.org": 1.0, "big-poker.fr": 1.0, "alphabets.example.com": 0.0}
    frame = spark.createDataFrame([(h, f"https://{h}/en/12") for h in unseen], "h string, url string")
    assert {r.h: r.blocked for r in model.predict(url_filters.lexical(frame, "url")).select("h", "blocked").collect()} == unseen


def test_trees_of_one_question_are_refused(spark):
    rows = [(f"http://{chr(97 + k % 26)}{k}.example.org/{'?a=1&b=2' if k % 2 else ''}", k % 2) for k in range(200)]
    frame = spark.createDataFrame(rows, "url string, label int")
    assert url_filters.train(frame, rounds=3).trees is not None
    refused = url_filters.train(frame, rounds=3, most_share=0.6)
    assert refused.trees is None and refused.predict(url_filters.lexical(frame, "url")).where("blocked > 0").count() == 0


def test_each_host_counts_once(spark):
    rows = [("http://a.example/1", 0)] * 50 + [("http://A.example/2", 1), ("https://b.example/x", 1), (None, 1), ("http://c.example/", None)]
    got = url_filters.one_per_host(spark.createDataFrame(rows, "url string, label int")).collect()
    assert sorted((r.url.split("/")[2].lower(), r.label) for r in got) == [("a.example", 0), ("b.example", 1)]


def test_grams_mark_the_ends_of_words(spark):
    row = spark.range(1).select(url_filters.host_words(F.lit("www.free-bets.example.com")).alias("w"), url_filters.gram_buckets(F.array(F.lit("ab"))).alias("g"), url_filters.host_words(F.lit("")).alias("none")).first()
    assert row.w == ["www", "free", "bets", "example"] and row.none == [] and len(row.g) == 3 and all(1 <= x <= url_filters.GRAM_BUCKETS for x in row.g)


def test_training_sample_is_bounded(spark):
    rows = [(f"http://a.example/{k}", 0) for k in range(900)] + [("http://copied.example/", 0)] * 5000 + [(f"http://b.example/{k}", 1) for k in range(30)]
    known = spark.createDataFrame(rows, "url string, label int")
    got = url_filters.training_sample(known, "url", "label", 200).collect()
    assert len(got) <= 130 and sum(r["label"] for r in got) == 30
    weights = {label: sum(r["weight"] for r in got if r["label"] == label) for label in (0, 1)}
    assert abs(weights[0] - 5900) < 1 and abs(weights[1] - 30) < 1e-6
