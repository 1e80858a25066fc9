import random
import zlib

import numpy as np
import pyarrow as pa
from skewline.llm import docstats, gbdt, quality, urls

SF01 = "/root/testdata/sf0.01"


def test_trees_learn_and_flat_walk_equals_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = gbdt.fit(x, y, trees=40, depth=3)
    p = gbdt.predict(model, x)
    assert ((p >= 0.5) == y).mean() > 0.97

    def walk(t, row, node=0):
        if node >= model["feature"].shape[1]:
            return model["leaf"][t, node - model["feature"].shape[1]]
        right = row[model["feature"][t, node]] > model["threshold"][t, node]
        return walk(t, row, 2 * node + 1 + right)

    for i in range(20):
        margin = model["prior"][0] + sum(walk(t, x[i]) for t in range(40))
        assert abs(1 / (1 + np.exp(-margin)) - p[i]) < 1e-12


def test_trees_without_rows_or_with_one_class():
    assert gbdt.predict(gbdt.fit(np.zeros((0, 1)), np.zeros(0)), np.zeros((3, 4))).tolist() == [0.5] * 3
    assert gbdt.predict(gbdt.fit(np.ones((9, 1)), np.ones(9)), np.zeros((2, 1))).min() > 0.9


def test_statistics_against_plain_counts():
    texts = ["Aa bb bb 12\nAa bb bb 12\n!!", None, "", "é é | *** X", "w" * 50, "  \n\t "]
    got = docstats.statistics(pa.array(texts, pa.string()))
    at = docstats.NAMES.index
    for row, t in zip(got, texts):
        w = [x for x in (t or "").split()]
        n = len((t or "").encode())
        assert abs(row[at("log_words")] - np.log1p(len(w))) < 1e-9 and abs(row[at("log_bytes")] - np.log1p(n)) < 1e-9
        if w:
            assert abs(row[at("distinct_words")] - len(set(w)) / len(w)) < 1e-9
            assert abs(row[at("top_word")] - max(map(w.count, w)) / len(w)) < 1e-9
            assert abs(row[at("repeated_next")] - sum(a == b for a, b in zip(w, w[1:])) / len(w)) < 1e-9
            assert abs(row[at("digit_words")] - sum(any(c.isdigit() for c in x) for x in w) / len(w)) < 1e-9
        lines = [x for x in (t or "").split("\n") if x]
        if lines:
            assert abs(row[at("distinct_lines")] - len(set(lines)) / len(lines)) < 1e-9
    whole = docstats.statistics(pa.array(texts * 3, pa.string()).slice(6, 6))
    assert np.allclose(whole, got)


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs.withColumnRenamed("n_chars", "score"), labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (3, "x" * 10_000_000, "d"), (1, None, "a")],
                                 "doc_id long, text string, stats string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs, none, keep=["stats"]).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and not any(r.held_out for r in rows if r.doc_id is None)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0


def host_path(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:stop]


def brute_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


ODD = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://com/", "ftp://a.net/es/://b",
       "http://x.net?q=/es/", "http://É.COM/ÉN/", "a://b\nc.net/es/\nd#e", "http://net/fr/", "http://notnet/fr/", "x://y.org/" + "p/" * 50_000]


def test_url_rules_against_brute_force(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(ODD)]
    rows += [(r.page_id + 100, r.url, "h", "p") for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()]
    rows.append(rows[-1])
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, score string")).collect()
    by_id = {i: u for i, u, *_ in rows}
    assert len(out) == len(rows)
    for r in out:
        assert (r.host, r.path) == host_path(by_id[r.page_id])
        fit = brute_rule(r.host, r.path)
        assert r.rule == (fit and fit[0]) and (r.verdict == fit[1] if fit else r.verdict in ("allow", "block"))


def test_url_trees_agree_with_rules_on_their_own_urls(spark):
    out = urls.judge(spark.read.parquet(f"{SF01}/pages.parquet")).where("rule is not null").collect()
    assert sum((r.score >= 0.5) == (r.verdict == "block") for r in out) / len(out) > 0.9


def test_url_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urls.judge(pages).collect()[0].verdict == "block"
    assert urls.judge(pages.limit(0)).count() == 0


def test_entropy():
    rng = random.Random(1)
    u = ["".join(rng.choice("abc") for _ in range(30)) for _ in range(5)]
    got = urls.lexical(*(pa.array(u) for _ in range(3)))[:, 4]
    for g, t in zip(got, u):
        assert abs(g + sum(t.count(c) / 30 * np.log(t.count(c) / 30) for c in set(t))) < 1e-9
