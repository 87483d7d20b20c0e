"""Vector and URL operators against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import topk, urls, vectors
from vellum.llm.queries import URL_RULES
from vellum.session import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, copies int, width int"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    out = []
    for i, v in enumerate(base):
        out.append((i, v, i % 3))
        for k in range(i % 4):
            out.append((1000 + 10 * i + k, v + rng.normal(size=16) * (0.03, 0.1, 0.6)[k], i % 3))
    out += [(5000 + k, base[0], 0) for k in range(5)] + [(5100, -base[0], 0), (5101, base[0] * 1e-30, 0), (5102, base[0] * 3, 1), (5103, base[0], None)]
    hub = rng.normal(size=16)
    out += [(6000 + k, hub + rng.normal(size=16) * 0.05, 2) for k in range(120)]
    out = [(i, [float(x) for x in v], l) for i, v, l in out]
    out += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 16, 0), (7003, [math.nan] * 16, 0), (7004, [math.inf] + [1.0] * 15, 0), (7005, [1.0, 2.0], 0), (7006, [2.0, 4.0], 0), (None, out[0][1], 0)]
    out += [(7007, [None] + [1.0] * 15, 0), (1000, out[1][1], 1), (7020, [5e-39] * 16, 2)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in out], SCHEMA)


def test_links_and_components(spark, odd):
    rows = [(r.vec_id, r.embedding, r.label) for r in odd.collect()]
    twin = [rows[0][1], [-x for x in rows[0][1]]]
    rows += [(8000, twin[0], 0), (8000, twin[1], 0), (8000, None, 0), (8001, twin[1], 0), (2**63 - 1, rows[3][1], rows[3][2]), (-5, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    able = [i for i, (d, v, l) in enumerate(rows) if d is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: (v := np.array(rows[i][1], float) / np.abs(rows[i][1]).max()) / np.linalg.norm(v) for i in able}
    links, root = defaultdict(int), {i: i for i in able}
    pairs = [(a, b) for n, a in enumerate(able) for b in able[n + 1 :] if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    before = None
    while root != before:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(lambda: 2**63)
    for i in able:
        least[root[i]] = min(least[root[i]], rows[i][0])
    comp = [least[root[i]] if i in root else rows[i][0] for i in range(len(rows))]
    want = [(d, links[i], comp[i], d is None or d == comp[i]) for i, (d, _, _) in enumerate(rows)]
    got = [tuple(r) for r in vectors.cosine_groups(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(d == 8000 for d, *_ in got) == 3 and max(n for _, n, _, _ in got) > 100


def test_blocks_and_longer_codes_change_nothing(odd):
    plain = {tuple(r) for r in vectors.cosine_groups(odd).collect()}
    assert {tuple(r) for r in vectors.cosine_groups(odd, block=16).collect()} == plain
    old, vectors.BUCKETED = vectors.BUCKETED, 2
    try:  # codes of two vertices and more
        longer = {tuple(r) for r in vectors.cosine_groups(odd, tables=24).collect()}
    finally:
        vectors.BUCKETED = old
    assert len(plain & longer) >= 0.9 * len(plain)
    assert vectors.cosine_groups(odd.where("vec_id < -1")).count() == 0


def test_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """Hard pairs in a table of any size: the same links, of which codes of more vertices lose some."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    links = lambda **more: {tuple(r) for r in vectors.cosine_groups(df, **more).collect()}
    plain = links()
    monkeypatch.setattr(vectors, "BUCKETED", 2)
    assert links(block=16) == plain and sum(n for _, n, _, _ in plain) > 0.999 * 3000
    assert links(hashes=7) != plain


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_of_hashing(hashes):
    """The hardest pairs there are, at the default tables and probes, for the codes of any table's size."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.9801 * a + math.sqrt(1 - 0.9801**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    ca, cb = (vectors.cross_polytope(x, vectors.TABLES, vectors.PROBES, vectors.SEED, hashes) for x in (a, b))
    meet = ((ca[:, :, :1] == cb).any(2) | (cb[:, :, :1] == ca).any(2)).any(1)
    assert meet.mean() > (0.999, 0.995, 0.99)[hashes - 1]
    x = rng.normal(size=(3, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def slow_topk(rows, k, every):
    live = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(live):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for m, (j, v) in enumerate(live) if m != n)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(8192, 512), (30, 2)])
def test_topk_matches_brute_force(odd, shard, block):
    more = odd.where("vec_id IN (1000, 20, 5000)").union(odd.where("vec_id = 20"))  # ids and whole rows that repeat
    rows = odd.unionByName(more).unionByName(odd.where("vec_id = 6001").withColumn("vec_id", F.lit(20).cast("long")))
    got = sorted(tuple(r) for r in topk.exact_topk(rows, 7, 20, shard_rows=shard, query_rows=block).collect())
    want = slow_topk([(r.vec_id, r.embedding) for r in rows.collect()], 7, 20)
    assert got == want and sum(q == 20 for q, *_ in got) == 4 * 7
    assert topk.exact_topk(odd.where("vec_id < -1")).count() == 0


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, 8), np.int64)
    x[:40] = rng.integers(50, 90, (40, 8))
    x[40:] = rng.integers(-2, 3, (3960, 8))
    lists = topk.Lists(np.arange(4000), np.arange(4000) * 2, x)
    scored = []
    merge = topk.Lists._merge
    try:
        topk.Lists._merge = staticmethod(lambda best, new, k, kth: (scored.append(len(new[0])), merge(best, new, k, kth))[1])
        q, ids, score = lists.search(np.array([-1]), np.array([[1, 2, 3, 1, 1, 1, 1, 2]]), 5)
    finally:
        topk.Lists._merge = staticmethod(merge)
    want = sorted((-int(v @ [1, 2, 3, 1, 1, 1, 1, 2]), i * 2) for i, v in enumerate(x))[:5]
    assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist())] == want and len(scored) == 1  # one round of the lists
    big = topk.Lists(np.arange(3), np.arange(3), np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]]))
    assert big.search(np.array([9]), np.array([[2**20, 1]]), 2)[2].tolist() == [2**60 + 2, 2**60 + 1]


# --- URLs ----------------------------------------------------------------------------------------


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n : n + m]


URLS = ["http://a.example.com/en/7?x=1", "HTTPS://Example.COM/en/70", "http://com/en/", "http://notcom/en/", "http://x.com/En/1", "https://b.net/de/1#t", "http://example.net/de/8", "http://m.example.net/de/81", "http://xexample.net/de/8", "http://q.org/es/", None, "", "no scheme", "://", "http://É.com/en/ü\n?q", "a://b://c/en/", "http://h?x=://", "http://q.org/es/"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "r")], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "url string, label string")
    got = {r.page_id: r for r in urls.judge_urls(pages, none, URL_RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = slow_parts(url)
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url
    assert got[None].rule == "example.com/en/7" and len(got) == len(URLS) + 1
    assert urls.judge_urls(pages.where("page_id < 0"), none, URL_RULES).count() == 0


def test_mined_rules_match_enumeration(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        tld, lang, key = rng.choice(["com", "net"]), rng.choice(["en", "de", "fr"]), rng.choice(["", "?ad=1"])
        bad = (tld == "com" and lang == "en") or (key and rng.random() < 0.9)
        rows.append((f"http://h{i % 5}.{tld}/{lang}/{i}{key}", "block" if bad else "allow"))
    rows += [(None, "block"), ("http://x.com/", None)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    tokens = labelled.select(urls.tokens_of(F.col("url")).alias("tokens"), "label")
    got = {(frozenset(r.tokens), r.verdict): (round(r.support, 9), round(r.confidence, 9)) for r in urls.mine_rules(tokens, 0.05, 0.8, 1.1, 2).collect()}
    data = [(frozenset(r.tokens), r.label) for r in tokens.collect() if r.label and r.tokens]
    n, items = len(data), sorted({t for s, _ in data for t in s})
    found = {}
    for k, a in enumerate(items):
        for part in [frozenset([a])] + [frozenset([a, b]) for b in items[k + 1 :]]:
            base = [l for s, l in data if part <= s]
            for label in ("block", "allow"):
                freq, whole = base.count(label), sum(l == label for _, l in data)
                if base and freq >= 0.05 * n and freq / len(base) >= 0.8 and freq / len(base) / (whole / n) >= 1.1:
                    found[part, label] = (round(freq / n, 9), round(freq / len(base), 9))
    want = {k: v for k, v in found.items() if not any(p < k[0] and l == k[1] and found[p, l][1] >= v[1] for p, l in found)}
    assert got == want and got
    pages = labelled.where("url IS NOT NULL").select(F.monotonically_increasing_id().alias("page_id"), "url")
    pages = pages.union(pages.limit(3)).union(spark.createDataFrame([(None, "http://h1.com/en/9?ad=1")], "page_id long, url string"))
    judged = urls.judge_urls(pages, labelled, [], min_support=0.05, min_confidence=0.8).collect()
    rules = urls.mine_rules(tokens, 0.05, 0.8).collect()
    of_url = {r.url: set(r.tokens) for r in pages.select("url", urls.tokens_of(F.col("url")).alias("tokens")).collect()}
    url_of = {(r.page_id, *slow_parts(r.url)): r.url for r in pages.collect()}
    for r in judged:  # the verdict by mined rules against all rules tried one by one
        fits = [(x.confidence, x.support, len(x.tokens), x.verdict, " ".join(x.tokens)) for x in rules if set(x.tokens) <= of_url[url_of[r.page_id, r.host, r.path]]]
        want = max(fits, default=None)
        assert (r.verdict, r.mined and " ".join(r.mined)) == ((want[3], want[4]) if want else ("allow", None))
    assert sum(r.verdict == "block" for r in judged) > 100 and len(judged) == pages.count() and all(r.rule is None for r in judged)


def test_long_shared_paths_are_mined_in_polynomial_time(spark):
    shared = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(f"http://a.com/{shared}/{'bad' if i % 2 else 'good'}/{i}", "block" if i % 2 else "allow") for i in range(60)]
    rows += [(f"http://b.com/other/{i}", "allow") for i in range(40)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    judged = urls.judge_urls(labelled.withColumn("page_id", F.lit(1)), labelled, []).collect()
    assert sum(r.verdict == "block" and r.mined == ["path:bad"] for r in judged) == 30 and sum(r.verdict == "allow" for r in judged) == 70


def test_queries_register_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op10_threshold_topk"])
def test_sql_equals_query(spark, data, name):
    import duckdb

    from vellum.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(found.fetchall())


def test_pages_and_documents_queries_run(spark, data):
    from vellum.llm.queries import QUERIES

    assert QUERIES["pages_language_id"](spark, data).count() == read_table(spark, data, "pages").count()
    assert QUERIES["op1_url_rules"](spark, data).count() == read_table(spark, data, "pages").count()
