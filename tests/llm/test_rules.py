"""URL rules, quality rules and decontamination against plain Python."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.llm import QUERIES, contamination, quality_rules
from calorix.llm.contamination import SeedRules, decontaminate, find_overlaps, fingerprint
from calorix.llm.quality_rules import OutlierRules, quality_verdicts
from calorix.llm.url_filter import build_cascade, judge_urls, listed
from tests.llm.data import documents, empty, texts, words

URLS = [
    None, "", "no scheme", "http://", "://a.com/x", "HTTP://Www.Example.COM/en/x?y#z", "http://example.com/en/",
    "http://example.com/en", "http://myexample.com/en/", "ftp://a.b.net/es/1", "http://net/es/", "http://net?x=/es/",
    "http://a.net#/fr/", "http://a.net/fr/?q=http://x.com/", "http://user@www.example.com/en/", "http://a.com:80/en/",
    "http://ÄÉ.com/", "http://a..net/fr/", "x://y://z.com/", "http://deep.www.example.com/en/a/b/" + "c/" * 500,
]


def judged(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def pages(spark, urls):
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, keys string, rule string")


def test_judge_urls(spark):
    from calorix.llm.url_filter import RULES

    rules = spark.createDataFrame([*RULES, (None, "block")], "rule string, verdict string")
    found = judge_urls(pages(spark, URLS * 3), rules)
    assert sorted(found.columns) == sorted(["page_id", "url", "keys", "host", "path", "rule", "verdict"])
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, RULES), r.url
    assert judge_urls(pages(spark, URLS).limit(0), rules).count() == 0
    none = judge_urls(pages(spark, URLS), rules.limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_many_rules(spark):
    draw = random.Random(5)
    host = lambda: ".".join(f"h{draw.randrange(6)}" for _ in range(draw.randrange(1, 4)))
    path = lambda: "/" + "".join(f"{draw.choice('ab')}/" for _ in range(draw.randrange(3)))
    rules = {host() + path(): draw.choice(["allow", "block"]) for _ in range(150)}
    urls = [f"http://{host()}{path()}x" for _ in range(400)]
    rows = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    for r in judge_urls(pages(spark, urls), rows).collect():
        assert (r.rule, r.verdict) == judged(r.url, rules.items())[2:], r.url


@pytest.mark.parametrize("n", [1, 40, 900])
def test_cascade_is_exact(spark, n):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    wanted = universe.where(F.substring("key", 2, 9).cast("int") < n)
    levels = build_cascade(wanted.unionByName(wanted), universe.unionByName(universe))
    right = universe.where(listed(F.col("key"), levels) == (F.substring("key", 2, 9).cast("int") < n))
    assert right.count() == 5000


def test_urls_match_sql(spark, folder):
    query = QUERIES["op2_url_filters"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    expected = duck.execute(query.sql)
    names = [d[0] for d in expected.description]
    found = query.build(spark, folder).select(*names).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected.fetchall(), key=key)


def base(text):
    w = (text or "").encode().split()
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = [False] * len(w)
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            hit[k : k + 8] = [True] * 8
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    counts = (
        len(w),
        sum(len(x.decode()) for x in w),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        sum(hit),
    )
    return counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def test_base_counts(spark):
    extra = [(50, "# a | b\n# a | b\n \n\n" + " ".join(words(9, 30)) + " <&>" + "again " * 9)]
    rows = texts() + extra
    expected = sorted((str(i), *base(t)[0], base(t)[1]) for i, t in rows)
    found = quality_verdicts(documents(spark, rows))
    assert found.select("row.*").columns == documents(spark, rows).columns
    got = [(str(r.row.doc_id), *(r[c] for c in quality_rules.BASE), r.base_failed) for r in found.collect()]
    assert sorted(got) == expected
    # too few rows for an estimate: the base rules decide
    assert all(r.kept != r.base_failed and r.distance is None for r in found.collect())
    assert quality_verdicts(empty(spark)).count() == 0


def brute_distances(x, rules):
    """The concentration steps on one group, in numpy."""
    d = x.shape[1]
    floor = np.diag(np.square(rules.scales))

    def estimate(rows):
        v = rows / 1024
        return v.mean(0), np.cov(v.T, bias=True) + floor

    def distance(mean, cov):
        v = x / 1024 - mean
        return (v @ np.linalg.inv(cov) * v).sum(1)

    mean, cov = estimate(x)
    near = (np.abs(x / 1024 - mean) <= np.sqrt(np.linalg.cholesky(cov).diagonal() ** 2)).all(1)
    best = None
    for start in ([mean, cov], estimate(x[near])):
        mean, cov = start
        for _ in range(rules.steps):
            bins = np.floor(np.log(distance(mean, cov) + 1e-3) * 24)
            before = np.array([(bins < b).sum() for b in bins])
            mean, cov = estimate(x[before < len(x) * rules.share])
        size = np.linalg.slogdet(cov)[1]
        if best is None or size < best[0] - 1e-12:
            best = size, distance(mean, cov)
    assert d == len(rules.scales)
    return best[1]


def test_robust_distances(spark):
    rules = OutlierRules(min_rows=40)
    rows = [(k, " ".join(words(k, 60 + k % 50))) for k in range(150)]
    rows += [(200 + k, " ".join(f"{w}***" for w in words(k, 80))) for k in range(20)]
    docs = documents(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    found = quality_verdicts(docs, rules=rules).collect()
    per_word = [base(t)[0] for _, t in rows]
    ids = [i for i, _ in rows]
    stats = []
    for (n, chars, symbols, _, repeats), (_, t) in zip(per_word, rows, strict=True):
        marks = sum(c in "!?.,;:" for c in t)
        capitals = sum("A" <= c <= "Z" for c in t)
        stats.append(
            [math.log(chars / n + 1), math.log1p(100 * symbols / chars), math.log1p(20 * capitals / chars),
             math.log1p(20 * marks / chars), repeats / n]
        )
    expected = dict(zip(ids, brute_distances(np.round(np.array(stats) * 1024), rules), strict=True))
    for r in found:
        assert r.distance == pytest.approx(expected[r.row.doc_id], rel=1e-6, abs=1e-9)
        assert r.kept == (r.row.doc_id < 200)


ITEM = " ".join(words("item", 40))


def test_overlaps(spark):
    w = ITEM.split()
    changed = [x if k % 9 else f"other{k}" for k, x in enumerate(w)]
    rows = [
        (1, "before " * 30 + ITEM + " after"),
        (2, "Before, " + ITEM.upper().replace(" ", ", ") + "!"),
        (3, " ".join(words(7, 40) + changed)),
        (4, " ".join(w[:9])),
        (5, " ".join(w[::-1])),
        (6, " ".join(words(8, 200))),
        (7, " ".join(w[10:26] + words(9, 30))),
        (8, None), (9, ""), (10, "tiny item here"), (11, "a tiny item there"), (12, "tiny. Item-HERE"),
        (1, "before " * 30 + ITEM + " after"),
    ]
    items = [(0, ITEM), (1, "tiny item here"), (2, None), (3, ""), (4, ITEM), (5, "--")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    for rules in (SeedRules(), SeedRules(max_broadcast=0)):
        found = find_overlaps(docs, benchmark, rules=rules)
        keyed = docs.select("doc_id", *fingerprint(F.col("text"))).join(found, ["k1", "k2"])
        got = {(r.doc_id, r.item_id): (r.matched, r.compared) for r in keyed.collect()}
        assert set(got) == {(1, 0), (2, 0), (3, 0), (7, 0), (10, 1), (12, 1)}
        assert got[1, 0] == (13, 13) and got[10, 1] == (3, 3)
        assert all(100 * m >= 80 * n for m, n in got.values())
    kept = decontaminate(docs, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8, 9, 11]
    assert kept.columns == docs.columns
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert find_overlaps(empty(spark), benchmark).count() == 0


def test_every_accepted_pattern_is_found(spark):
    """All sets of changed tokens that the rule accepts, at the ends of a text and inside one."""
    sizes = [3, 5, 6, 8, 9, 10, 11, 12, 13, 16]
    held = {n: [f"w{n}x{k}" for k in range(n)] for n in sizes}
    rows, expected = [], set()
    for n, item in held.items():
        width = min(n, 13)
        for changed in (c for k in range(4) for c in itertools.combinations(range(n), k)):
            text = [f"other{k}" if k in changed else t for k, t in enumerate(item)]
            best = max(sum(k not in changed for k in range(a, a + width)) for a in range(n - width + 1))
            if best >= math.ceil(width * 0.8):
                expected.add((len(rows), n))
            rows.append((len(rows), " ".join(text if len(rows) % 2 else ["before", *text, "after"])))
    long = [f"long{k}" for k in range(60)]
    for a in range(5):
        expected.add((len(rows), 60))
        rows.append((len(rows), " ".join(f"other{k}" if k % 5 == a else t for k, t in enumerate(long))))
    # only eleven tokens of the item are there at all
    expected.add((len(rows), 13))
    rows.append((len(rows), " ".join(held[13][1:12])))
    items = [*((n, " ".join(t)) for n, t in held.items()), (60, " ".join(long))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    found = find_overlaps(docs, benchmark)
    keyed = docs.select("doc_id", *fingerprint(F.col("text"))).join(found, ["k1", "k2"])
    assert {(r.doc_id, r.item_id) for r in keyed.collect()} == expected


def test_verbatim_items_are_found(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    held = [(d.doc_id, plain(d.text)) for d in docs]
    expected = {(i, b.item_id) for b in items for i, t in held if plain(b.text) in t}
    found = contamination.op7_decontamination(spark, folder).collect()
    assert expected <= {(r.doc_id, r.item_id) for r in found}
