import collections
import random
import re

import numpy as np
import pytest

from lumenframe.llm.components import components
from lumenframe.llm.jaccard import Search, jaccard_components, keep_one_of_each, op7_divide_skip, shingles

from .conftest import SCHEMA, nasty_rows, prose

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, by comparing all pairs."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in jaccard_components(df, **more).collect()), key=repr)


def test_shingles_match_the_definition():
    for _, text, *_ in nasty_rows():
        assert len(shingles(text)) == len(plain_set(text))
    assert len(shingles("a b c d e")) == 1 and len(shingles("\x0b \x0c")) == 0
    assert shingles("A b C d E f").tolist() == shingles("a B c D e F").tolist() and shingles("a b").tolist() != shingles("a b a b").tolist()


def test_nasty_documents_match_brute_force(spark, nasty):
    rows = [(r[0], r[1]) for r in nasty_rows()]
    assert found(nasty) == brute(rows)
    assert found(nasty, group_bytes=30_000, task_docs=1) == brute(rows)


def test_buckets_in_two_levels_match_brute_force(spark, nasty):
    rows = [(r[0], r[1]) for r in nasty_rows()]
    for fan in (1, 2, 5):
        assert found(nasty, group_bytes=20_000, fan=fan) == brute(rows)


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    rows = [(1, a), (9, a), (9, b), (7, b), (7, c), (20, c + " more"), (30, prose(24, 50)), (31, prose(24, 50))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert found(df) == brute(rows) == found(df, group_bytes=300, fan=2)


def edited(seed, words, n):
    r = random.Random(seed)
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(1_000)}"
    return " ".join(out)


def test_chains_of_near_copies_match_brute_force(spark):
    """Groups whose members lie near the threshold, passages that many share, and exact copies."""
    rows, passage = [], prose(99, 40)
    for g in range(6):
        base = prose(g, 90 + 40 * g).split()
        for k in range(14):
            rows.append((1_000 - len(rows), edited(100 * g + k, base, k % 5)))
    rows += [(2_000 + k, prose(500 + k, 50) + " " + passage) for k in range(20)] + [(3_000 + k, passage) for k in range(3)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(6)
    expected = brute(rows)
    assert len({c for *_, c in expected}) < len(rows) - 30
    for limits in ({}, {"group_bytes": 4_000}, {"group_bytes": 4_000, "task_docs": 3}):
        assert found(df, **limits) == expected


def test_search_finds_all_links():
    r = random.Random(1)
    sets = []
    for _ in range(15):
        base = r.sample(range(3_000), r.randrange(1, 120))
        for _ in range(6):
            s = set(base)
            for _ in range(r.randrange(0, 8)):
                s.add(r.randrange(3_000))
            sets.append(np.array(sorted(s), np.uint64))
    sizes = np.array([len(s) for s in sets])
    search = Search(np.arange(len(sets)), sizes, sets, 75)
    for q, s in enumerate(sets):
        mine = set(search.search(s, len(s), search.fits(len(s))))
        assert mine == {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}


def test_defined_results(spark, no_documents, clashing):
    assert jaccard_components(no_documents).count() == 0 and keep_one_of_each(no_documents).count() == 0
    kept = keep_one_of_each(clashing)
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == clashing.columns and ids[None] == 2 and 0 in ids and 1 not in ids and 2 not in ids and ids[12] == 2 and 3 in ids and 4 in ids and 5 in ids


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(40)] + [(500, 500), (601, 600), (600, 601)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    roots = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {x: x for uv in links for x in uv}
    for _ in range(200):
        for u, v in links:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert {k: v for k, v in parent.items() if k != v} == roots
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op7_on_test_tables_matches_brute_force(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert sorted((tuple(r) for r in op7_divide_skip(spark, f"/root/testdata/{sf}").collect()), key=repr) == brute(list(zip(t["doc_id"], t["text"])))
