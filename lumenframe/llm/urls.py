"""URL filter: listed rules first, mined association rules for the rest; DataFrame operations only.

URLs that a listed rule decides are the labelled rows. From all their tokens, combinations
that hold a verdict are mined level by level; combinations below the support or confidence
bound, and those that a shorter one with the same verdict makes redundant, are pruned. The
rest are matched to the distinct token sets of all URLs by an inverted index from token to rules.
The sets' verdicts return to the rows by a digest of the set: those of the few sets that very
many rows have are broadcast, so that such rows don't meet in one task, and only rows with
other sets are shuffled.

Defined results: a null URL, or one without ``://``, has empty host and path, no tokens
and the default verdict; without labelled rows nothing is mined and the default holds.
Repeated rows are judged alike, each for itself. URLs of any length are read whole. Of several
mined rules that match, the one of the highest confidence holds, then the longest, the most
frequent, and the first by its tokens. An empty table gives an empty table; other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stored, table

#: Token sets that at least this share of the open rows have are broadcast with their verdict; there can't be more than its reciprocal, of 100 bytes each.
HOT_SHARE = 0.001


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def listed(host: Column, path: Column, rules: Sequence[ListedRule]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest listed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, sorted: host labels, path segments (runs of digits become #) and names of query parameters."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    numberless = F.regexp_replace(path, r"[0-9]+", "#")
    kinds = [("h:", F.split(host, r"\.")), ("p:", F.split(numberless, "[/.]")), ("q:", F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))))]

    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    return F.array_sort(F.array_distinct(F.concat(*[named(*k) for k in kinds])))


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> list[MinedRule]:
    """Rules from rows of ``tokens`` and ``verdict``, best first; those that a shorter one with the same verdict and no less confidence makes redundant are left out.

    Sets of tokens grow by one token a level, over whole transactions. One is carried on while a
    verdict with it reaches the support bound, it has several verdicts, and it is rarer than each
    of its subsets. Nothing is lost: a set as frequent as a subset gives the subset's confidences.
    So tokens that always come together make no combinations, and only the support bounds the rest.
    """
    n = labelled.count()
    if not n:
        return []
    spark, least = labelled.sparkSession, max(1, math.ceil(min_support * n))
    rules: list[MinedRule] = []
    # Sets to carry on, with their frequency and each verdict's best confidence by rules inside them.
    carried: dict[tuple[str, ...], tuple[int, dict[str, float]]] = {(): (n, {})}
    longer = labelled.select(F.explode(F.transform(F.array_distinct("tokens"), lambda t: F.array(t))).alias("items"), "verdict", F.lit(1).alias("n"))
    grown = F.transform("rest", lambda t, i: F.struct(F.concat("items", F.array(t)).alias("items"), F.slice("rest", i + 2, F.size("rest")).alias("rest")))
    while carried:
        counts = longer.groupBy("items", "verdict").agg(F.sum("n").alias("n")).groupBy("items").agg(F.collect_list(F.struct("verdict", "n")).alias("counts"))
        following = {}
        for r in counts.filter(F.exists("counts", lambda c: c["n"] >= least)).collect():  # their number is bounded by the support
            items, by = tuple(r["items"]), dict(r["counts"])
            total, inside = sum(by.values()), [carried.get(items[:k] + items[k + 1 :]) for k in range(len(items))]
            if None in inside or (len(items) > 1 and any(t == total for t, _ in inside)):
                continue
            best: dict[str, float] = {}
            for _, confidences in inside:
                best |= {v: c for v, c in confidences.items() if c > best.get(v, 0)}
            for verdict, k in by.items():
                if k >= least and k / total >= min_confidence and k / total > best.get(verdict, 0):
                    rules.append(MinedRule(items, verdict, k / total, k / n))
                    best[verdict] = k / total
            if len(by) > 1:
                following[items] = total, best
        if following:
            # The rows that hold ``items``, by the tokens after its last one and the verdict, as in FP-growth; only tokens carried on can make longer sets.
            if () in carried:
                known = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isin([i[0] for i in following]))))
                held = labelled.select(F.array().cast("array<string>").alias("items"), known.alias("rest"), "verdict").groupBy("items", "rest", "verdict").agg(F.count("*").alias("n"))
                held = held.select(F.inline(grown), "verdict", "n")
            else:
                names = spark.createDataFrame([(list(items),) for items in following], "items array<string>")
                held = longer.join(F.broadcast(names), "items", "left_semi").groupBy("items", "rest", "verdict").agg(F.sum("n").alias("n"))
            longer = stored(held, "held").select(F.inline(grown), "verdict", "n")
        carried = following
    return sorted(rules, key=lambda r: (-r.confidence, -len(r.tokens), -r.support, r.tokens, r.verdict))


def match(token_sets: DataFrame, rules: Sequence[MinedRule]) -> DataFrame:
    """The rows (all different) whose ``tokens`` hold all those of a rule, with the best such rule's verdict."""
    postings = [(t, rank, len(r.tokens), r.verdict) for rank, r in enumerate(rules) for t in r.tokens]
    index = token_sets.sparkSession.createDataFrame(postings, "token string, rule int, need int, verdict string")
    hits = token_sets.select("*", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")  # the index is bounded by the mined rules
    full = hits.groupBy(*token_sets.columns, "rule", "need", "verdict").agg(F.count("*").alias("hits")).filter(F.col("hits") == F.col("need"))
    return full.groupBy(*token_sets.columns).agg(F.min_by("verdict", "rule").alias("verdict"))


def set_digest(tokens: Column) -> Column:
    return F.sha2(F.to_json(tokens), 256)


def filter_urls(pages: DataFrame, url: str, rules: Sequence[ListedRule], min_support: float = 0.005, min_confidence: float = 0.8, default: str = "allow", hot_share: float = HOT_SHARE) -> DataFrame:
    """All rows and columns, with host, path, rule and verdict."""
    names = fresh(pages.columns, "host", "path", "rule", "verdict", "tokens", "set_digest", "found_digest", "found_verdict")
    host, path, rule, verdict, tokens, digest, found_digest, found_verdict = names
    df = pages.withColumn(host, url_parts(quoted(url))[0]).withColumn(path, url_parts(quoted(url))[1])
    by_rule = listed(quoted(host), quoted(path), rules)
    df = df.withColumn(rule, by_rule[0]).withColumn(verdict, by_rule[1]).withColumn(tokens, url_tokens(quoted(url), quoted(host), quoted(path)))
    is_open = quoted(rule).isNull()
    mined = mine(df.filter(~is_open).select(quoted(tokens).alias("tokens"), quoted(verdict).alias("verdict")), min_support, min_confidence)
    columns = [quoted(c) for c in (*pages.columns, host, path, rule)]
    if not mined:
        return df.select(*columns, F.coalesce(quoted(verdict), F.lit(default)).alias(verdict))
    df = df.withColumn(digest, set_digest(quoted(tokens)))
    sets = df.filter(is_open).groupBy(quoted(digest).alias("digest")).agg(F.any_value(quoted(tokens)).alias("tokens"), F.count("*").alias("rows"))
    sets = stored(sets, "url-sets")
    open_rows = sets.agg(F.sum("rows")).first()[0] or 0
    found = stored(match(sets, mined).select(F.col("digest").alias(found_digest), F.col("verdict").alias(found_verdict), "rows"), "url-verdicts")
    is_hot = F.col("rows") >= hot_share * open_rows
    hot, others = found.filter(is_hot).drop("rows"), found.filter(~is_hot).drop("rows")
    same = quoted(digest) == quoted(found_digest)
    known = df.join(F.broadcast(hot), is_open & same, "left")
    ready = quoted(verdict).isNotNull() | quoted(found_verdict).isNotNull()
    rest = known.filter(~ready).drop(found_digest, found_verdict).join(others, same, "left")
    decided = F.coalesce(quoted(verdict), quoted(found_verdict), F.lit(default)).alias(verdict)
    return known.filter(ready).select(*columns, decided).unionAll(rest.select(*columns, decided))


#: The rules that the query's contract lists.
CONTRACT_RULES = (
    ListedRule("allow", "com", "/"),
    ListedRule("block", "example.com", "/en/"),
    ListedRule("allow", "www.example.com", "/en/"),
    ListedRule("block", "net", "/es/"),
    ListedRule("block", "net", "/fr/"),
)


def op5_association_rules(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, "url", CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict")
