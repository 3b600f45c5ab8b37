"""N-gram join, top-k search, URL filter: against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import ngram_join, url_filter, vector_search
from tradewind.llm.components import components

SF = "/root/testdata/sf0.01"
W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = W.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    """doc_id -> (set size, least id reachable), by an inverted index over all pairs that share a shingle."""
    sets, parent, index = {}, {}, defaultdict(set)
    for i, text in rows:
        sets[i], parent[i] = shingles(text), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in index[x]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].add(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def planted():
    """Chains and families around the threshold: every text differs from its base by some words."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, i = [], 0
    for size in (4, 6, 9, 14, 25, 60, 63, 66, 130, 400):
        base = [word() for _ in range(size)]
        for copies in range(14):
            text = list(base)
            for _ in range(copies // 2):
                text[int(rng.integers(0, len(text)))] = word()
            if copies % 3 == 1:
                text += [word() for _ in range(size // 12)]
            rows.append((i, " ".join(text).title() if copies % 4 == 2 else " ".join(text)))
            i += 7
    shared = [word() for _ in range(60)]
    for k in range(40):
        rows.append((i + k, " ".join(shared + [word() for _ in range(k)])))
    return rows


@pytest.mark.parametrize("table", ["given", "planted"])
def test_join_by_brute_force(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "given" else spark.createDataFrame(planted(), "doc_id long, text string")
    want = expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_join_awkward(awkward, nothing):
    rows = ngram_join.near_copies(awkward).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert len(rows) == 12
    assert got[(5, 56, 5)] == 2 and got[(6, 56, 5)] == 1 and got[(8, 1, 8)] == 1 and got[(9, 1, 8)] == 1
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1 and got[(None, 36, None)] == got[(None, 0, None)] == 1
    assert ngram_join.near_copies(nothing).count() == 0


def test_bitmap_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(1, 2**63, 600, dtype=np.uint64))
        a, b = np.sort(rng.choice(pool, 300, replace=False)), np.sort(rng.choice(pool, 280, replace=False))
        flips = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.bitmap(a) ^ ngram_join.bitmap(b))
        assert flips <= len(np.setxor1d(a, b))


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40, 0, -1)] + [(100, k) for k in range(101, 130)] + [(500, 500)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 42)} | {i: 100 for i in range(100, 130)} | {500: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, queries, k):
    q = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in q:
        if queries(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_search_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", 64)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 25 == 0)).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 25 == 0, 10)


def test_search_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [9.0, 9.0]), (100, [0.0, -1.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score long, rank int")
    got = [tuple(r) for r in vector_search.top_k(vectors, vectors.where("vec_id % 100 = 0 or vec_id = 3")).collect()]
    assert sorted(got) == brute_top(rows, lambda i: i % 100 == 0, 10) and len(got) == 10
    assert vector_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0 == vector_search.top_k(vectors, vectors.limit(0)).count()


URLS = [
    "http://Example.ORG/es/x?y#z", "https://a.b.example.org/en/12", "http://example.org", "http://xexample.org/es/", "ftp://x.com/fr/a#b", "http://com/fr/", "http://x.com/de/?q", "x://y.com?/de/", "no url", "", None,
    "://org/", "http:///path", "http://a.com/DE/", "a://b://c.com/fr/", "http://ÉX.org/é", "http://" + "a." * 3000 + "org/" + "x" * 5000,
]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(r), v == "block", r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_by_brute_force(spark):
    given = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS + given + URLS)] + [(None, URLS[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), (r["host"], r["path"], r["rule"], r["verdict"])) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES)).collect())
    assert got == sorted((-1 if i is None else i, brute_url(u)) for i, u, *_ in rows)
    none = spark.createDataFrame([], "rule_host string, rule_path string, rule string, verdict string")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, RULES)).count() == 0
