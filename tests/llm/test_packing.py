import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenframe.llm.packing import complete_bins, cut, default_tokenizer, encoder, fillings, lower_bound, op2_bin_completion, pack, pack_documents, sequences

from .conftest import prose


def bins_of(patterns):
    return [items for n, items in patterns for _ in range(n)]


def best_by_search(sizes, capacity):
    """Fewest bins, by trying all assignments of a few items."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_bins_are_optimal_on_small_cases():
    r = random.Random(0)
    for _ in range(120):
        capacity = r.randrange(10, 60)
        sizes = sorted((r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 10))), reverse=True)
        patterns = complete_bins(collections.Counter(sizes), capacity)
        bins = bins_of(patterns)
        assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        assert lower_bound(collections.Counter(sizes), capacity) <= len(bins) == best_by_search(sizes, capacity)


def test_large_histograms_reach_the_bound():
    r = random.Random(1)
    counts = collections.Counter(int(min(2048, r.expovariate(1 / 500) + 1)) for _ in range(100_000))
    patterns = complete_bins(counts, 2048)
    used = collections.Counter()
    for n, items in patterns:
        for s in items:
            used[s] += n
    assert used == counts and sum(n for n, _ in patterns) == lower_bound(counts, 2048)


def test_fillings_are_undominated_and_best_first():
    counts = {9: 1, 7: 1, 5: 2, 3: 1}
    found = fillings(counts, 12)
    assert sum(found[0]) == 12 and [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)
    assert complete_bins({}, 10) == []
    with pytest.raises(ValueError):
        complete_bins({11: 1}, 10)


def test_thousands_of_short_pieces():
    r = random.Random(3)
    mixed = collections.Counter(int(min(2048, r.expovariate(1 / 500) + 1)) for _ in range(6_000)) + collections.Counter({1: 3_000})
    for counts in ({1: 5_000}, {2: 5_000}, {1: 3_000, 2: 3_000}, mixed):
        patterns = complete_bins(counts, 2048)
        used = collections.Counter()
        for n, items in patterns:
            assert sum(items) <= 2048
            for s in items:
                used[s] += n
        assert used == collections.Counter(counts) and sum(n for n, _ in patterns) == lower_bound(counts, 2048)
    assert sum(n for n, _ in complete_bins({1: 50_000}, 8192)) == 7  # a filling may take more items than the search may try


def test_cut():
    for n in (1, 5, 10, 11, 20, 27):
        parts = list(cut(np.zeros(n), 10))
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:])) and sum(k for _, k in parts) == n
        assert all(k == 10 for _, k in parts[1:])


def test_fast_encoder_equals_the_file():
    encode = encoder(default_tokenizer())
    assert encode.fast is not None
    r = random.Random(2)
    texts = ["", " ", "\n\n \t", "a<|endoftext|>b", "I'll 've 12345  ½ ٣ é😀 naïve", "x" * 20_000, " " * 3_000, prose(1, 500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F6FF), 10, 32])) for _ in range(300)) for _ in range(40)]
    texts += ["<|endoftext|>", "x" * 5_000 + " <|endoftext|>\n<|endoftext", "<|endof text|>"]
    file = Tokenizer.from_file(default_tokenizer())
    for t in texts:
        assert encode(t) == file.encode(t, add_special_tokens=False).ids
    assert encode(None) == [] and encode("a<|endoftext|>b") == [64, 50256, 65]


def check_packed(rows, docs, capacity=2048):
    encode = encoder(default_tokenizer())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    expected = collections.Counter()
    for d in docs:
        ids = np.array([*encode(d["text"]), 0], "<u4")
        for k, (s, n) in enumerate(cut(ids, capacity)):
            expected[d["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(by)


def test_nasty_documents(spark, clashing, no_documents):
    rows = pack_documents(clashing, default_tokenizer()).collect()
    assert check_packed(rows, clashing.collect()) >= -(-sum(r["length"] for r in rows) // 2048)
    assert pack_documents(no_documents, default_tokenizer()).count() == 0


def test_hot_lengths_are_spread(spark):
    items = spark.createDataFrame([(k, 0, 0, 700 if k % 3 else 648, 1) for k in range(3_000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = pack(items).collect()
    assert len(rows) == 3_000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3_000 and len({r["sequence_id"] for r in rows}) == 1_000


def test_empty_texts_are_packed(spark):
    docs = spark.range(5_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', NULL) AS text")
    assert check_packed(pack_documents(docs, default_tokenizer()).collect(), docs.collect()) == 3


def test_sequences_hold_the_documents_tokens(spark, nasty):
    encode = encoder(default_tokenizer())
    packed = pack_documents(nasty, default_tokenizer()).cache()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in packed.collect())
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in sequences(packed).collect()}
    assert max(map(len, whole.values())) <= 2048
    parts = collections.defaultdict(list)
    for r in packed.collect():
        assert (whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()
        parts[r["doc_id"]].append((r["start"], r["ids"]))
    for d in nasty.filter("doc_id in (0, 2, 4, 8, 9, -5)").collect():
        assert b"".join(x for _, x in sorted(parts[d["doc_id"]])) == np.array([*encode(d["text"]), 0], "<u4").tobytes()


def test_items_keep_columns_of_any_name(spark):
    names = ["length", "low", "high", "each", "number", "at", "chunk", "in_chunk", "rank", "before", "offset", "sequence_id", "plan_length", "of_chunk"]
    items = spark.createDataFrame([(5 + k % 4, *[k] * (len(names) - 1)) for k in range(50)], names)
    rows = pack(items, 20).collect()
    assert list(rows[0].asDict()) == [*names, "sequence_id_", "offset_"] and sorted(r["low"] for r in rows) == list(range(50))


def test_the_search_leaves_the_first_descent():
    # Best fit first takes 6 + 4 and so on; three bins need other fillings.
    counts = collections.Counter([7, 6, 6, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2, 2, 2])
    assert sum(n for n, _ in complete_bins(counts, 12)) == lower_bound(counts, 12) == 5
    r = random.Random(8)
    better = 0
    for _ in range(60):
        counts = collections.Counter(r.randrange(8, 34) for _ in range(24))
        one, many = (sum(n for n, _ in complete_bins(counts, 60, nodes)) for nodes in (0, 400))
        better += many < one
        assert many <= one
    assert better


def test_op2_reaches_the_bound(spark):
    rows = op2_bin_completion(spark, "/root/testdata/sf0.001").collect()
    n = check_packed(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert n == -(-sum(r["length"] for r in rows) // 2048)
