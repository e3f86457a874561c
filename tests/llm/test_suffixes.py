import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm.packed import FAN, Dealing
from lumenframe.llm.suffixes import LENGTH, Corpus, Ranges, Runs, multikey_sort, op6_suffix_array, remove_repeats, repeat_digests, sliding_min

from .conftest import SCHEMA, nasty_rows, prose


def brute(rows, length=LENGTH):
    """(n_bytes, n_removed, n_spans, sha) of each row, by a table of all windows."""
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            least[s] = min(i, least.get(s, i))
    out = []
    for (i, b), (own, _) in zip(data, rows):
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if least[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in repeat_digests(df, **more).collect()), key=repr)


def test_nasty_documents_match_brute_force(spark, nasty):
    rows = [(r[0], r[1]) for r in nasty_rows()]
    assert found(nasty, group_bytes=40_000) == brute(rows)
    assert found(nasty) == brute(rows)


def test_random_low_entropy_texts_match_brute_force(spark):
    r = random.Random(4)
    phrases = ["".join(r.choice("ab ") for _ in range(r.randrange(20, 120))) for _ in range(12)]
    rows = [(k * 7 % 61 - 10, "".join(r.choice(phrases) for _ in range(r.randrange(0, 12))) + "".join(r.choice("abcé") for _ in range(r.randrange(0, 80)))) for k in range(60)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    for group_bytes in (3_000, 1 << 20):
        assert found(df, group_bytes=group_bytes) == brute(rows)


def test_buckets_in_two_levels_match_brute_force(spark, nasty):
    rows = [(r[0], r[1]) for r in nasty_rows()]
    for fan in (1, 3, 6):
        assert found(nasty, group_bytes=20_000, fan=fan) == brute(rows)


def test_ranges_keep_equal_anchors_together_and_split_others():
    r = np.random.default_rng(1)
    first, second = r.integers(0, 4, 3_000).astype(np.uint64) << np.uint64(61), r.integers(0, 2**63, 3_000).astype(np.uint64)
    both = [int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") for a, b in zip(first, second)]
    splitters = np.array(sorted(both)[100::500], "S16")
    for fine in (1, 5):
        bucket = Ranges(splitters, fine).of(first, second)
        assert (bucket // fine).tolist() == [sum(s <= x for s in sorted(both)[100::500]) for x in both] and len(set(bucket.tolist())) == 7 * fine
        assert (Ranges(splitters, fine).of(first, second) == bucket).all()


def test_tasks_stay_bounded_as_the_input_grows():
    """Buckets follow the input in number; what a node or bucket holds and the rows for each group don't grow."""
    for groups in (10, 5_000, 100_000, 6_000_000):
        d = Dealing(groups, groups)
        assert d.coarse <= FAN and groups <= d.coarse * d.fine <= 2 * groups + 8 and -(-groups // d.districts) <= FAN
        if groups < FAN * FAN:
            assert d.fine <= FAN


def test_other_lengths(spark):
    rows = [(1, prose(1, 60)), (2, prose(2, 10) + prose(1, 60)[50:200]), (3, prose(1, 60)[100:180] + "zz" + prose(1, 60)[90:150])]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for length in (24, 30, 79):
        assert found(df, length=length, group_bytes=300) == brute(rows, length)
    with pytest.raises(ValueError):
        repeat_digests(df, length=10)


def test_runs_cover_each_window_once():
    texts = [prose(k, 90).encode() for k in range(4)] + [b"", b"short", b"y" * 400]
    runs = Runs(Corpus(list(range(7)), texts), LENGTH)
    windows = sorted(int(f) + k for f, n in zip(runs.first, runs.count) for k in range(n))
    starts = np.cumsum([0, *map(len, runs.corpus.texts)])
    assert windows == [int(s) + j for s, t in zip(starts, runs.corpus.texts) for j in range(len(t) - LENGTH + 1)]
    assert (runs.anchor >= runs.first + runs.count - 1).all() and (runs.anchor <= runs.first + LENGTH - 16).all()


def test_multikey_sort_and_sliding_min():
    r = np.random.default_rng(2)
    words = [r.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, classes = multikey_sort(words)
    rows = [tuple(int(w[k]) for w in words) for k in order]
    assert rows == sorted(rows) and len(set(classes)) == len(set(rows)) and all((rows[k] == rows[k + 1]) == (classes[k] == classes[k + 1]) for k in range(499))
    assert len(multikey_sort([np.zeros(0, np.uint64)])[0]) == 0
    x = r.integers(0, 1000, 200)
    for width in (1, 2, 7, 35):
        assert sliding_min(x, width).tolist() == [x[k : k + width].min() for k in range(200 - width + 1)]


def test_remove_repeats_keeps_rows_and_columns(spark, clashing, no_documents):
    out = remove_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == dict((r[0], r[1]) for r in nasty_rows()[:1])[0] and texts[1] == "" and texts[3] is None
    assert remove_repeats(no_documents).count() == 0 and repeat_digests(no_documents).count() == 0


def test_op6_on_test_tables_matches_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert sorted((tuple(r) for r in op6_suffix_array(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(list(zip(t["doc_id"], t["text"])))
