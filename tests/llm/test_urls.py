import itertools
import math
import random
import re

from lumenframe.llm.urls import CONTRACT_RULES, MinedRule, filter_urls, match, mine, op5_association_rules

from .conftest import CLASHING

URLS = [
    "http://A.Example.com/en/1?x=1", "https://www.example.com/en/2#top", "http://www.example.com", "http://b.org/fr/3", "ftp://x.net/es/9", "http://x.net/fr/", "http://net/fr/1", "http://xnet/fr/1", "http://spam.example.org/en/casino/77?utm=1",
    "no scheme", "", None, "://", "http://", "http://u:p@host.com:80/a?b://c", "http://é.net/es/ü", "HTTP://COM/x\n/y", "x" * 5_000 + "://y.com/" + "z/" * 3_000,
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for r in CONTRACT_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best.text if best else None, best.verdict if best else None


def test_listed_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS * 2)], "page_id long, url string")
    rows = filter_urls(pages, "url", CONTRACT_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path, rule, verdict = plain(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_mining_matches_brute_force(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["a", "b", "c"], "block")] * 3 + [(["c"], "allow")] * 2
    labelled = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, verdict string")
    found = {(r.tokens, r.verdict): round(r.confidence, 9) for r in mine(labelled, 0.1, 0.6)}
    expected = {}
    for size in (1, 2, 3):
        for combo in itertools.combinations("abc", size):
            for v in ("allow", "block"):
                have = [x for x in rows if set(combo) <= set(x[0])]
                n = sum(x[1] == v for x in have)
                if have and n >= 0.1 * len(rows) and n / len(have) >= 0.6:
                    if not any(set(k) < set(combo) and w == v and c >= round(n / len(have), 9) for (k, w), c in expected.items()):
                        expected[combo, v] = round(n / len(have), 9)
    assert found == expected


def test_mining_reads_all_frequent_tokens_and_whole_transactions(spark):
    # 300 tokens above the support bound, 15 a URL. With the 15th of each kind a URL is blocked, without it allowed.
    rows = [([f"t{kind:02}{k:02}" for k in range(14 + (j < 12))], "block" if j < 12 else "allow") for kind in range(20) for j in range(20)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    expected = {((f"t{kind:02}14",), "block", 1.0, 12 / 400) for kind in range(20)}
    assert {(r.tokens, r.verdict, r.confidence, r.support) for r in mine(labelled, 0.005, 0.8)} == expected


def test_long_rules_are_found_among_many_tokens(spark):
    # Eleven tokens are everywhere; each of four is missing in some allowed rows, and only all four together are blocked.
    common = [f"a{k:02}" for k in range(11)]
    rows = [(common + ["w", "x", "y", "z"], "block")] * 8 + [(common + [t for t in "wxyz" if t != out], "allow") for out in "wxyz" for _ in range(5)]
    found = {(r.tokens, r.verdict): r.confidence for r in mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8)}
    assert found == {(("w", "x", "y", "z"), "block"): 1.0}


def test_mining_matches_brute_force_on_random_rows(spark):
    draw = random.Random(5)
    rows = [(sorted(t for t in "abcdefgh" if draw.random() < 0.6), draw.choice(["allow", "block", "block"])) for _ in range(60)]
    found = {(r.tokens, r.verdict): r.confidence for r in mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.7)}
    expected = {}
    for size in range(1, 9):
        for combo in itertools.combinations("abcdefgh", size):
            have = [v for t, v in rows if set(combo) <= set(t)]
            for v in ("allow", "block"):
                n = have.count(v)
                if n >= 0.05 * len(rows) and n / len(have) >= 0.7 and not any(set(k) < set(combo) and w == v and c >= n / len(have) for (k, w), c in expected.items()):
                    expected[combo, v] = n / len(have)
    assert found == expected and max(len(t) for t, _ in found) > 2


def test_inverted_index_takes_the_best_whole_match(spark):
    rules = [MinedRule(("a", "b"), "block", 1.0, 0.5), MinedRule(("c",), "allow", 0.9, 0.5), MinedRule(("a",), "allow", 0.8, 0.5)]
    sets = spark.createDataFrame([(["a", "b", "c"],), (["a", "c"],), (["a"],), (["z"],), ([],)], "tokens array<string>")
    assert {tuple(r["tokens"]): r["verdict"] for r in match(sets, rules).collect()} == {("a", "b", "c"): "block", ("a", "c"): "allow", ("a",): "allow"}


def test_defined_results(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, "url", CONTRACT_RULES).count() == 0
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in CLASHING])
    out = filter_urls(pages, "url", CONTRACT_RULES)
    assert out.columns[: len(pages.columns)] == pages.columns and out.count() == len(URLS)
    nothing = spark.createDataFrame([(1, "http://b.org/fr/3"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in filter_urls(nothing, "url", CONTRACT_RULES).collect()} == {"allow"}


def test_method_blocks_what_looks_like_blocked(spark):
    rows = [f"http://spam{k}.example.net/es/cheap/{k}" for k in range(200)] + [f"http://good{k}.example.com/de/news/{k}" for k in range(200)]
    rows += ["http://other.org/xx/cheap/1", "http://other.org/xx/news/1"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    verdicts = {r["url"]: r["verdict"] for r in filter_urls(pages, "url", CONTRACT_RULES).collect()}
    assert verdicts["http://other.org/xx/cheap/1"] == "block" and verdicts["http://other.org/xx/news/1"] == "allow"


def plain_tokens(url):
    host, path, _, _ = plain(url)
    query = re.split("#", url or "", maxsplit=1)[0].split("?", 1)
    parts = [("h:", host.split(".")), ("p:", re.split("[/.]", re.sub("[0-9]+", "#", path))), ("q:", [x.split("=")[0] for x in query[1].split("&")] if len(query) > 1 else [])]
    return frozenset(kind + x for kind, xs in parts for x in xs if x)


def plain_verdicts(urls, min_support, min_confidence):
    """All subsets of all labelled token sets, then the best rule inside each URL's set."""
    labelled = [(plain_tokens(u), plain(u)[3]) for u in urls if plain(u)[2] is not None]
    counts = {}
    for tokens, verdict in labelled:
        for size in range(1, len(tokens) + 1):
            for combo in itertools.combinations(sorted(tokens), size):
                counts.setdefault(combo, {}).setdefault(verdict, 0)
                counts[combo][verdict] += 1
    least = math.ceil(min_support * len(labelled))
    rules = [(-k / sum(by.values()), -len(combo), -k, combo, v) for combo, by in counts.items() for v, k in by.items() if k >= least and k / sum(by.values()) >= min_confidence]
    best = {}
    for confidence, _, _, combo, v in sorted(rules, key=lambda r: len(r[3])):  # a rule that a shorter one makes redundant goes
        if not any((c, v) in best and best[c, v] <= confidence for n in range(1, len(combo)) for c in itertools.combinations(combo, n)):
            best[combo, v] = confidence
    kept = sorted(r for r in rules if (r[3], r[4]) in best)
    return [plain(u)[3] or next((v for *_, combo, v in kept if set(combo) <= plain_tokens(u)), "allow") for u in urls]


def test_open_urls_are_judged_as_by_brute_force(spark):
    draw = random.Random(11)
    hosts, words = ["a.com", "b.example.com", "www.example.com", "x.net", "y.net", "z.org", "w.org"], ["en", "fr", "es", "cheap", "news", "win", "77"]
    urls = [f"http://{draw.choice(hosts)}/{draw.choice(['en', 'fr', 'es'])}/{draw.choice(words)}/{draw.choice(words)}" + draw.choice(["", "?utm=1", "?q=2&r=3#top"]) for _ in range(400)]
    urls += ["http://q.org/cheap/77"] * 300 + [None, "", "http://"]
    expected = plain_verdicts(urls, 0.02, 0.75)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for hot_share in (0.001, 0.2, 2.0):
        rows = filter_urls(pages, "url", CONTRACT_RULES, 0.02, 0.75, hot_share=hot_share).collect()
        assert [r["verdict"] for r in sorted(rows, key=lambda r: r["page_id"])] == expected
    assert "block" in {v for u, v in zip(urls, expected) if plain(u)[2] is None}


def test_clashing_columns(spark):
    rows = [f"http://spam{k}.net/es/cheap/{k}" for k in range(40)] + [f"http://good{k}.com/news/{k}" for k in range(40)] + ["http://o.org/cheap/1"]
    taken = ["host", "tokens", "digest", "rows", "set_digest", "found_digest", "found_verdict", "found_tokens_", "found_verdict_", "items", "rest", "n"]
    pages = spark.createDataFrame([(k, u, *range(len(taken))) for k, u in enumerate(rows)], ["page_id", "url", *taken])
    out = filter_urls(pages, "url", CONTRACT_RULES)
    assert out.columns[: len(pages.columns)] == pages.columns and out.count() == len(rows)
    assert out.filter("page_id = 80").first()["verdict"] == "block"


def test_op5_columns(spark):
    df = op5_association_rules(spark, "/root/testdata/sf0.001")
    assert df.columns == ["page_id", "host", "path", "rule", "verdict"] and df.count() == 50
