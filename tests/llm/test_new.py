"""Whitening, the prefix trie and url filters against brute force and SQL twins, on the given tables and on awkward rows."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recfeat.llm import prefixtrie, queries, urlfilter, whitening

from .. import duck

# Whitening


def brute_whitening(vectors, most=32):
    """Rows, exact deviations, components and eigenvalues with numpy's own solver."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    f = np.array([[a - b / n for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(f.T @ f / n)
    return n, dev, f, e[::-1][:most], u[:, ::-1][:, :most]


def test_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    n, dev, f, e, u = brute_whitening([r.embedding for r in rows])
    got = queries.op11_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == 32 * len(rows) and {r.n for r in got} == {n}
    at = {r.vec_id: i for i, r in enumerate(rows)}
    w = np.zeros((len(rows), 32))
    for r in got:
        assert r.deviation == dev[at[r.vec_id]]
        assert math.isclose(r.explained, e[r.component - 1] / np.square(f).sum() * n, rel_tol=1e-9)
        w[at[r.vec_id], r.component - 1] = r.whitened
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    want = f @ u / np.sqrt(e)
    assert np.abs(w - want * np.sign((w * want).sum(0))).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    """Nulls, NaNs, odd lengths, repeated rows, directions without variance, equal eigenvalues and huge entries."""
    rng = np.random.default_rng(3)
    good = [[float(a), float(b), 1.5, float(a)] for a, b in rng.normal(size=(40, 2))]
    bad = [None, [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i % 39, v, "x") for i, v in enumerate(good)] + [(100 + i, v, "y") for i, v in enumerate(bad)] + [(None, good[0], "z")]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    got = whitening.whitened_rows(made).collect()
    n, dev, f, e, _ = brute_whitening([*good, good[0]])
    assert len(got) == 2 * 41 and {r.n for r in got} == {41} and {r.component for r in got} == {1, 2}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(dev) and got[0].identity_error < 1e-9
    assert sorted({round(r.explained, 12) for r in got}, reverse=True) == [round(x / e.sum(), 12) for x in e[:2]]

    cross = [[s * (8.0 if i == k else 0.0) for i in range(5)] for k in range(5) for s in (1, -1)]  # five equal eigenvalues
    even = whitening.fit(spark.createDataFrame([(v,) for v in cross], "embedding array<double>"))
    assert even.vectors.shape == (5, 5) and np.abs(even.vectors.T @ even.vectors - np.eye(5)).max() < 1e-12 and even.identity_error < 1e-9
    near = [[s * (8.0 + k / 64 if i == k else 0.0) for i in range(5)] for k in range(5) for s in (1, -1)]
    assert np.allclose(np.abs(whitening.fit(spark.createDataFrame([(v,) for v in near], "embedding array<double>")).vectors), np.eye(5)[:, ::-1])

    huge = [[1e30, 0.0], [-1e30, 1.0], [3.0, 2.0]]
    assert {r.deviation for r in whitening.whitened_rows(spark.createDataFrame([(i, v) for i, v in enumerate(huge)], "vec_id long, embedding array<double>")).collect()} == {None, 384**2 + 192**2}
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [None], [[]]):
        assert whitening.whitened_rows(spark.createDataFrame([(1, v) for v in few], "vec_id long, embedding array<double>")).count() == 0


def test_exact_sums_and_polynomial(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(-(1 << 62), 1 << 62, size=(9, 3))
    want = np.array([[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)], object)
    assert (whitening.gram(y) == want).all()
    b = rng.integers(-9, 9, size=(6, 4)).astype(object)
    for m in (b.T @ b, np.diag(np.array([5, 5, 0, 7], object)), np.diag(np.array([10**40, 3, 1, 1], object))):
        d, c, power = len(m), [1], np.eye(len(m), dtype=int).astype(object)
        for k in range(1, d + 1):  # Faddeev and LeVerrier's recurrence
            ma = m.dot(power)
            c.append(-int(np.trace(ma)) // k)
            power = ma + c[-1] * np.eye(d, dtype=int).astype(object)
        poly = whitening.characteristic_polynomial(spark, m)
        assert poly == c[::-1]
        assert [whitening.roots_above(poly, a) for a in (-1, 10**41)] == [d, 0]


# The prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            name = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, name, role or "", text or ""))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if seqs[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TALK = "conv_id long, turn long, role string, text string"


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*TRIE).collect())


def odd_talk():
    """Hot beginnings and copies, missing bases, null and repeated turns, ends inside others, one long conversation."""
    talk = [(c, t, "user" if t % 2 == 0 else "bot", f"say {t} {c // 40 if t > 3 else 0}") for c in range(0, 160) for t in range(c % 11)]
    talk += [(c, t, "user", "hello") for c in range(1000, 1160) for t in range(9)]
    talk += [(2000, t, "user", f"long {t}") for t in range(700)] + [(2001, t, "user", f"long {t}") for t in range(650)]
    talk += [(3003, 1, None, None), (3003, 1, "", ""), (3003, None, "a", "b"), (3003, None, None, "é"), (3001, 5, "x", "y")]
    talk += [(None, 1, "user", "nobody"), (-7, 1, "user", "below"), (-5, 0, "user", "base"), (-7, 1, "user", "below")]
    return talk


@pytest.mark.parametrize(("cells", "partitions"), [(1 << 20, 1), (1 << 20, 7), (300, 3), (1, 13)])
def test_trie_and_its_cuts(spark, cells, partitions):
    """Matrices and shards of any size give the same nodes; so do copies that fill several shards."""
    rows = odd_talk()
    made = spark.createDataFrame(rows, TALK).withColumn("path", F.lit(1)).withColumn("kind", F.lit("clash"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie_rows(prefixtrie.trie(prefixtrie.rebuilt(made), cells))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_trie(rows)


def test_trie_of_the_given_tables(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert trie_rows(queries.op12_prefix_trie(spark, sf_dir)) == brute_trie([tuple(r) for r in talk.select("conv_id", "turn", "role", "text").collect()])
    assert prefixtrie.conversation_trie(talk.limit(0)).count() == 0


def test_trie_twin(spark, tmp_path):
    spark.createDataFrame([r for r in odd_talk() if r[0] is None or r[0] < 2000 or r[0] > 2001], TALK).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    duck.compare(queries.op12_prefix_trie(spark, str(tmp_path)), con, queries.ORACLE["op12_prefix_trie"])


# Url filters

PAGES = "page_id long, url string, html string"


def link(to, kind="canonical"):
    return f'<html><head><link rel="{kind}" href="{to}"></head>' if kind == "canonical" else f"<META HTTP-EQUIV='refresh' content='0; url={to}'>"


def pages():
    hot = [(1000 + i, f"http://m{i}.star.com/p", link("http://hub.star.com/")) for i in range(60)]
    chain = [(2000 + i, f"http://chain.com/{i}", link(f"/{i + 1}", "refresh")) for i in range(40)] + [(2040, "http://chain.com/40", link("http://www.example.com/de/end"))]
    return hot + chain + [
        (1, "http://a.example.net/de/x", "none"), (2, "http://b.com/y#f", link("https://a.example.net/de/x")), (3, "http://c.com/z", "<LINK\nhref='/y' rel='canonical'><!-- <link rel=canonical href=http://q.net/> -->"),
        (4, "http://c.com/y/", link("//b.com/y", "refresh")), (5, "HTTP://ORG/fr/", link("http://s.net/k")), (6, "http://t.com", link("http://s.net/k")), (7, None, None), (8, "nourl", link("http://s.net/k")),
        (None, "http://example.com/de/q", None), (9, "http://net/de", ""), (10, "http://net", ""), (11, "http://c.com/z/d/e", '<meta http-equiv=refresh content="30;url=http://x.net/">'),
        (12, "http://w.com/d/e", link("f?a=1&amp;b=2")), (13, "http://w.com/d/f?a=1&b=2", link("http://example.net/de/")), (14, "http://EXAMPLE.net/en/A?q#f", ""), (14, "http://EXAMPLE.net/en/A?q#f", ""),
        (15, "http://xnet/", ""), (16, "http://foo.example.net.com/", link("mailto:x@y.net")), (17, "ftp://k.org?x=/fr/", ""), (18, "http://v.com/" + "a/" * 3000, link("#top")), (19, "://org/fr/x", ""), (20, "http://hub.star.com", link("http://bad.net/")),
        (21, "http://u.com/q", link("?v=2")), (22, "http://u.com/q?v=2", link("http://n.net/")), (23, "http://net:80/", ""),
    ]


def brute_urls(rows):
    import re

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        query = re.match(r"(\?[^#]*)?", rest[len(host) + len(path) :])[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, query

    def rule(host, path):
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    name = lambda h, p, q: h + p.rstrip("/") + q if h else None
    group, said = {}, defaultdict(list)

    def root(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for _, url, html in rows:
        h, p, q = split(url)
        if not h:
            continue
        said[name(h, p, q)].append(rule(h, p))
        for tag in re.findall(r"(?is)<(?:link|meta)\s[^>]*>", re.sub(r"(?s)<!--.*?-->", "", html or "")):
            at = None
            if re.search(r"(?i)\srel\s*=\s*[\"']?\s*canonical[\s\"'/>]", tag):
                at = re.search(r"(?i)\shref\s*=\s*[\"']?\s*([^\s\"'>]+)", tag)
            elif re.search(r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh[\s\"'/>]", tag):
                at = re.search(r"(?i)\scontent\s*=\s*[\"']?\s*\d(?:\.\d*)?\s*[;,]\s*url\s*=\s*[\"']?\s*([^\s\"'>]+)", tag)
            t = at[1].replace("&amp;", "&") if at else "#"
            if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", t):
                to = t
            elif t.startswith("//"):
                to = "x:" + t
            elif t.startswith("#") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", t):
                continue
            else:
                to = f"x://{h}" + (t if t[0] == "/" else p + t if t[0] == "?" else (p[: p.rfind("/") + 1] or ("/" if not p else "")) + t)
            th, tp, tq = split(to)
            if th:
                said[name(th, tp, tq)].append(rule(th, tp))
                group[root(name(h, p, q))] = root(name(th, tp, tq))
    all_said = defaultdict(list)
    for k, rules in said.items():
        all_said[root(k)] += [r for r in rules if r]
    out = []
    for i, url, _ in rows:
        h, p, q = split(url)
        r = rule(h, p) if h else None
        others = all_said[root(name(h, p, q))] if h else []
        block = any(x.verdict == "block" for x in others) and not any(x.verdict == "allow" for x in others)
        out.append((i, h, p, r and r.host + r.path, r.verdict if r else "block" if block else "allow"))
    return sorted(out, key=str)


def test_urls(spark, sf_dir, tmp_path):
    rows = pages()
    made = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("address", F.lit(1)).repartition(4)
    got = urlfilter.judge(made)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "via"]
    found = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    assert found == brute_urls(rows)
    blocked = {r[0] for r in found if r[4] == "block"}
    assert {2, 3, 4, 12, 13, 20, 21, 22, 1000, 1059, 2000, 2040} <= blocked and not {5, 7, 8, 10, 11, 14, 15, 16, 18} & blocked
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted((tuple(r)[:5] for r in queries.op13_url_filter(spark, sf_dir).collect()), key=str) == brute_urls([tuple(r) for r in given.select("page_id", "url", "html").collect()])
    assert urlfilter.judge(given.limit(0)).count() == 0
    assert {r.page_id for r in urlfilter.allowed(made).collect()} == {r[0] for r in found if r[4] == "allow"} | {None}

    spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    duck.compare(queries.op13_url_filter(spark, str(tmp_path)), con, queries.ORACLE["op13_url_filter"])


def test_redirect_log_and_allow_precedence(spark):
    """Links known from elsewhere count like those of pages, and one allowed alias keeps all that no rule fits."""
    made = spark.createDataFrame([(1, "http://one.com/a", None), (2, "http://two.com/b", None), (3, "http://three.com/c", None), (4, "http://x.net/d", None)], PAGES)
    log = [("http://one.com/a", "http://x.net/d"), ("http://two.com/b", "http://www.org/fr/e"), ("http://www.org/fr/e", "http://y.net/f"), (None, "http://z.net/"), ("http://three.com/c", None)]
    out = {r.page_id: (r.verdict, r.via) for r in urlfilter.judge(made, links=spark.createDataFrame(log, "url string, target string")).collect()}
    assert out == {1: ("block", "net/"), 2: ("allow", None), 3: ("allow", None), 4: ("block", None)}


def test_rules_by_length(spark):
    """The longest rule wins, whatever part of it is long; without rules all is allowed."""
    rules = [urlfilter.Rule(*r) for r in itertools.chain([("block", "com", "/"), ("allow", "b.com", "/x"), ("block", "com", "/x/long"), ("allow", "a.b.com", "")], [("block", f"h{i}.org", f"/{'p' * i}") for i in range(30)])]
    urls = ["http://a.b.com/", "http://b.com/x/longer", "http://b.com/x/", "http://com/", "http://h7.org/pppppppp", "http://h7.org/pppppp", "http://c.com"]
    made = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    assert [r.rule for r in sorted(urlfilter.judge(made, rules).collect())] == ["a.b.com", "com/x/long", "b.com/x", "com/", "h7.org/ppppppp", None, None]
    assert {r.verdict for r in urlfilter.judge(made, []).collect()} == {"allow"}
