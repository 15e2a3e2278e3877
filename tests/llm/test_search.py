"""URL filters, centroid clustering and ranked search: by hand, against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from memloom.llm import centroids, lexical_search, url_filters
from memloom.llm import queries as llm


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_centroid_clustering", "op13_lexical_search"])
def test_query_equals_sql(same_rows, name):
    same_rows(llm.QUERIES[name], llm.ORACLES[name])


# URL filters

NO_OUTCOMES = "host string, bad int"


def test_rules_and_parts_of_urls(spark):
    urls = {
        "https://WWW.Example.NET/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/1?x=/en/": ("example.net", "/de/1", "net/", "block"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://net#/x": ("net", "", None, "allow"),
        "http://a.b.example.com/de/": ("a.b.example.com", "/de/", "example.com/de/", "block"),
        "http://a.example.com/DE/": ("a.example.com", "/DE/", None, "allow"),
        "ftp://x.org/fr/a://b.net/": ("x.org", "/fr/a://b.net/", "org/fr/", "allow"),
        "://?q": ("", "", None, "allow"),
        "no scheme.net/en/": ("", "", None, "allow"),
        "http://ÀÉ.Net/a\nb": ("ÀÉ.net", "/a\nb", "net/", "block"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, spark.createDataFrame([], NO_OUTCOMES)).collect()}
    assert [found[i] for i in range(len(urls))] == list(urls.values())


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.shop.co.uk:8080": ("shop.co.uk", "co.uk"), "me@localhost": ("localhost", "localhost"), "10.0.0.1:80": ("10.0.0.1", ""), "": ("", ""), "example.org.": ("example.org", "org")}
    found = url_filters.with_domains(spark.createDataFrame([(h,) for h in hosts], "host string"))
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == hosts


def _by_hand(outcomes, hosts):
    """The same hierarchy in plain Python: bad_mean and bad_bound of each host."""
    split = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    count = lambda of: {k: (sum(1 for h, _ in outcomes if of(h) == k), sum(b for h, b in outcomes if of(h) == k)) for k in {of(h) for h, _ in outcomes}}

    def strength(level, parent):
        chi = sum(round(1e6 * (b - n * parent(k)) ** 2 / (n * parent(k) * (1 - parent(k)))) for k, (n, b) in level.items())
        more = sum(n - 1 for n, _ in level.values())
        rho = min(max((chi - 1e6 * len(level)) / (1e6 * more) if more else 0.05, 0.001), 0.5)
        return (1 - rho) / rho

    rate = (sum(b for _, b in outcomes) + 1) / (len(outcomes) + 2)
    means = [lambda _: rate]
    for of in (lambda h: split(h)[1], lambda h: split(h)[0], lambda h: h):
        level, above = count(of), means[-1]
        one = {of(h): h for h, _ in outcomes}
        k = strength(level, lambda key, one=one, above=above: above(one[key]))
        means.append(lambda h, of=of, level=level, k=k, above=above: (k * above(h) + level.get(of(h), (0, 0))[1]) / (k + level.get(of(h), (0, 0))[0]))
    n = count(lambda h: h)
    # hosts without outcomes of their domain or suffix take what is above
    mean = {h: means[-1](h) for h in hosts}
    return {h: (n.get(h, (0, 0))[0], round(m, 6), round(m - 1.645 * math.sqrt(m * (1 - m) / (n.get(h, (0, 0))[0] + k + 1)), 6)) for h, m in mean.items()}


def test_reputation_against_plain_python(spark):
    dice = random.Random(5)
    outcomes = [(h, int(dice.random() < p)) for h, p, n in (("spam.bad.com", 0.95, 300), ("ok.bad.com", 0.3, 40), ("a.good.org", 0.05, 200), ("b.good.org", 0.02, 90), ("c.mid.com", 0.2, 7)) for _ in range(n)]
    hosts = ["spam.bad.com", "ok.bad.com", "new.bad.com", "a.good.org", "new.org", "x.fresh.net", ""]
    pages = spark.createDataFrame([(i, f"http://{h}/de/x" if h else None) for i, h in enumerate(hosts)], "page_id long, url string")
    made = url_filters.judge(pages, spark.createDataFrame(outcomes, NO_OUTCOMES), rules=()).collect()
    found = {r["host"]: (r["n_labelled"], r["bad_mean"], r["bad_bound"]) for r in made}
    wanted = _by_hand(outcomes, hosts)
    assert {h: x[0] for h, x in found.items()} == {h: x[0] for h, x in wanted.items()}
    for h in hosts:
        assert found[h][1:] == pytest.approx(wanted[h][1:], abs=2e-6)
    verdict = {r["host"]: r["verdict"] for r in made}
    assert verdict["spam.bad.com"] == "block" and {verdict[h] for h in hosts[3:]} == {"allow"}
    # an unknown host of a bad domain is judged by the domain
    assert found["new.bad.com"][1] > found["x.fresh.net"][1] > found["new.org"][1]


def test_url_filter_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "http://a.net/1", "x"), (1, "http://a.net/1", "x"), (2, "http://" + "a." * 5000 + "org/" + "p" * 100_000 + "7", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, None), (1, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    outcomes = url_filters.labelled_pages(pages, labels)
    assert sorted(rows(outcomes, "host", "bad"))[0][1] == 1 and outcomes.count() == 3
    made = url_filters.judge(pages, outcomes)
    assert made.count() == 4 and made.where("verdict is null or host is null").count() == 0
    assert url_filters.judge(pages.where("false"), outcomes).count() == 0


# centroid clustering


def _lloyd(vectors, k, rounds):
    """(cluster, distance, centroids) in Python's integers."""
    x = [[math.floor(256 * v) if abs(v) < 1e300 else int(v) * 256 for v in row] for _, row in vectors]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"2:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centre = [x[i] for i in order[:k]]

    def assign():
        gaps = [[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centre] for row in x]
        return [min(range(len(centre)), key=lambda i: (g[i], i)) for g in gaps], [min(g) for g in gaps]

    for _ in range(rounds):
        found, _ = assign()
        for c in set(found):
            own = [row for row, f in zip(x, found, strict=True) if f == c]
            centre[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return *assign(), centre


@pytest.mark.parametrize("size", [1.0, 1e6, 1e30])
def test_clusters_against_plain_python(spark, size):
    dice = np.random.default_rng(3)
    vectors = [(int(i), [float(v) for v in dice.normal(0, size, 8)]) for i in range(120)] + [(5, [0.0] * 8), (None, [size] * 8), (None, [size] * 8), (9, [-1.0 / 512] * 8)]
    found = centroids.clustered(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), clusters=7, rounds=4, dim=8)
    cluster, distance, centre = _lloyd(vectors, 7, 4)
    most = centroids.LONGEST
    wanted = sorted(((str(v[0]), c, min(d, most), min(sum(e for e, f in zip(distance, cluster, strict=True) if f == c), most), min(sum(distance), most), centroids.digest(centre[c])) for v, c, d in zip(vectors, cluster, distance, strict=True)))
    if size > 1e9:  # distances beyond a long are held at the largest one before they are added up
        wanted = [(*w[:3], *w[5:]) for w in wanted]
    got = [(str(r[0]), *r[1:]) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    assert sorted((*g[:3], *g[5:]) if size > 1e9 else g for g in got) == wanted


def test_clusters_leave_out_what_is_no_vector(spark):
    vectors = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (2**53 + 1, [3.0, 4.0]), (7, [])]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, cluster string")
    found = centroids.clustered(table, dim=2)
    assert sorted(rows(found, "vec_id", "distance")) == [(1, 0), (2**53 + 1, 0)]
    assert centroids.clustered(table.where("vec_id in (2, 3)"), dim=2).count() == 0
    # equal vectors: the lower of two equal centroids takes both
    same = spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<float>")
    assert sorted(r[0] for r in rows(centroids.clustered(same, dim=2).where("vec_id = 1"), "cluster")) in ([0, 0], [1, 1])


# ranked search


def _ranked(docs, items, best):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        found += [(item, rank, d[3], -d[0]) for rank, d in enumerate(sorted(scored)[:best], 1)]
    return found


def _texts(seed, n, words):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Été", "日本", "A1"]
    return [" ".join(dice.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=dice.choice((1, 3, 20, 60)))) for _ in range(n)]


@pytest.mark.parametrize("cells,docs", [(1 << 13, 1 << 15), (40, 37)])
def test_search_against_brute_force(spark, cells, docs):
    table = list(enumerate(_texts(1, 400, 150)))
    table += [(3, table[8][1]), (None, table[8][1]), (900, None), (901, "-- ##"), (902, table[8][1].upper())]
    items = list(enumerate(_texts(2, 25, 150))) + [(3, "w1, W1; unknown"), (None, "w2 w3"), (77, ""), (78, None), (79, "--"), (80, "unknown words")]
    made = lexical_search.search(spark.createDataFrame(table, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), best=7, cells=cells, shard_docs=docs)
    assert sorted(rows(made, "item_id", "rank", "doc_id", "score"), key=repr) == sorted(_ranked(table, items, 7), key=repr)


def test_wand_equals_full_scores():
    dice = np.random.default_rng(0)
    term_rows = [np.unique(dice.zipf(1.3, 30) % 200).astype(np.int32) for _ in range(3000)]
    tf_rows = [dice.integers(1, 5, len(r)) for r in term_rows]
    n = np.array([int(r.sum()) + 1 for r in tf_rows])
    df = np.bincount(np.concatenate(term_rows), minlength=200)
    weights = np.array([lexical_search.term_weight(3000, int(d)) for d in df])
    shard = lexical_search.Shard(pa.array(range(3000)), n, term_rows, tf_rows, weights, 3000, int(n.sum()))
    items = [np.sort(dice.choice(200, k, replace=False)) for k in (1, 2, 5, 12)]
    item, doc, score = shard.search(items, 10)
    for i, own in enumerate(items):
        full = np.zeros(3000, np.int64)
        for t in own:
            span = slice(shard.start[t], shard.end[t])
            full[shard.doc[span]] += shard.impact[span]
        order = np.lexsort((np.arange(3000), -full))[:10]
        order = order[full[order] > 0]
        assert doc[item == i].tolist() == order.tolist() and score[item == i].tolist() == full[order].tolist()


def test_search_odd_rows(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, "the same TEXT", "x"), (1, "the same TEXT", "x"), (2, "été", "x"), (3, "x" * 200_000, "x")], "item_id long, text string, number string")
    plain = sorted(rows(lexical_search.search(odd, items), "item_id", "rank", "doc_id"), key=repr)
    assert plain == sorted(rows(lexical_search.search(clashing, items), "item_id", "rank", "doc_id"), key=repr)
    assert [r for r in plain if r[0] in (2, 3)] == [(2, 1, 7), (3, 1, 9)]
    assert len([r for r in plain if r[0] == 1 and r[1] == 1]) == 2
    assert lexical_search.search(empty, items).count() == 0 and lexical_search.search(odd, items.where("false")).count() == 0
