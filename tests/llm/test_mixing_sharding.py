import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from lumenframe.llm.mixing import mix_sources, poisson_cdf, source_rates
from lumenframe.llm.sharding import op8_two_pass_shuffle, read_shards, shuffle_into_shards, write_shards

from .conftest import as_rows


def test_cdf_is_poisson(spark):
    for rate in (0.3, 1.0, 7.5, 32.0):
        cdf = spark.range(1).select(poisson_cdf(F.lit(rate))).first()[0]
        for k in (0, int(rate), int(rate) + 9):
            exact = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1))
            assert abs(cdf[k] - exact) < 1e-12
        assert 1 - cdf[-1] < 1e-12 and len(cdf) < 140


def test_counts_are_those_of_a_plain_version(spark):
    """Rates from 0.3 to 3,000, some of them drawn in parts."""
    rows = [(k, "rare" if k == 0 else "mid" if k < 40 else "hot") for k in range(4_000)]
    weights, total = {"rare": 0.75, "mid": 0.2, "hot": 0.05}, 4_000
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), "source", ["doc_id"], weights=weights, seed=9)
    found = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
    size = collections.Counter(s for _, s in rows)
    for i, s in rows:
        rate = weights[s] / sum(weights.values()) * total / size[s]
        parts, want = max(1, math.ceil(rate / 32)), 0
        for j in range(parts):
            u = int(hashlib.md5(f"9|{i}{f'|{j}' if j else ''}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < 140:
                k += 1
                p *= rate / parts / k
                c += p
            want += k
        assert found[i] == want
    assert abs(found[0] - 3_000) < 250


def test_rates_reach_targets(spark):
    df = spark.createDataFrame([(k, "big" if k % 10 else "small") for k in range(20_000)], "doc_id long, source string")
    out = mix_sources(df, "source", ["doc_id"], weights={"big": 1, "small": 1}, seed=3)
    n = collections.Counter(r["source"] for r in out.collect())
    assert abs(n["small"] - 10_000) < 400 and abs(n["big"] - 10_000) < 400
    assert sum(r["weight"] for r in source_rates(df, "source")[0].collect()) == pytest.approx(1)


def test_salted_join_gives_the_same(spark):
    df = spark.createDataFrame([(k, f"s{k % 7}" if k % 3 else None) for k in range(2_000)], "doc_id long, source string")
    a, b = (as_rows(mix_sources(df, "source", ["doc_id"], seed=3, broadcast_bytes=n), "doc_id", "source", "copy", "shuffle_key") for n in (1 << 20, 1))
    assert a == b and {r[1] for r in a} >= {None}


def test_mixing_defined_results(spark, nasty, clashing, no_documents):
    a = mix_sources(nasty, "source", ["doc_id"], seed=5)
    assert as_rows(a, "doc_id", "source") == as_rows(mix_sources(nasty.repartition(5), "source", ["doc_id"], seed=5), "doc_id", "source")
    assert mix_sources(no_documents, "source", ["doc_id"]).count() == 0
    b = mix_sources(clashing, "source", ["doc_id"], seed=5)
    assert b.columns[: len(clashing.columns)] == clashing.columns and b.columns[-2:] == ["copy_", "shuffle_key_"] and b.count() == a.count()
    assert mix_sources(nasty, "source", ["doc_id"], weights={"zzz": 1.0}).count() == 0
    keys = [r["shuffle_key"] for r in a.coalesce(1).sortWithinPartitions("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_shards_are_even_gapless_and_repeatable(spark):
    df = spark.range(10_007).withColumnRenamed("id", "doc_id")
    rows = shuffle_into_shards(df, ["doc_id"], 40, 1, bucket_bytes=300_000).collect()
    assert len(rows) == 10_007 and len({r["doc_id"] for r in rows}) == 10_007
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = shuffle_into_shards(df.repartition(7), ["doc_id"], 40, 1, bucket_bytes=300_000)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) - 5_000) < 300  # shuffled


def test_sharding_defined_results(spark, nasty, clashing, no_documents, tmp_path):
    assert shuffle_into_shards(no_documents, ["doc_id"], 4, 1).count() == 0
    done = shuffle_into_shards(clashing, ["doc_id", "text"], 4, 1)
    assert done.columns == [*clashing.columns, "shard_", "slot_"] and done.count() == clashing.count()
    write_shards(nasty, str(tmp_path / "out"), ["doc_id", "text"], 4, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == nasty.count()
    with pytest.raises(ValueError):
        shuffle_into_shards(nasty, ["doc_id"], 0, 1)
    assert sum(r["n"] for r in shuffle_into_shards(spark.range(3), ["id"], 40, 1).groupBy("shard").agg(F.count("*").alias("n")).collect()) == 3


def test_written_shards_have_all_slots_in_many_files(spark, tmp_path):
    df = spark.range(2_003).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(7).alias("at"), F.lit(1).alias("offset"))
    write_shards(df, str(tmp_path / "out"), ["doc_id"], 5, 3, bucket_bytes=20_000)
    rows = read_shards(spark, str(tmp_path / "out"), df.schema).withColumn("file", F.col("_metadata.file_path")).collect()
    assert sorted((r["doc_id"], r["text"], r["at"]) for r in rows) == sorted((r["doc_id"], r["text"], r["at"]) for r in df.collect())
    for k in range(5):
        own = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) in (400, 401)
        files = collections.defaultdict(list)
        for r in own:
            files[r["file"]].append(r["slot"])
        assert len(files) > 3 and all(s == list(range(min(s), max(s) + 1)) for s in files.values())


def test_rows_with_equal_keys_spread_over_buckets(spark, tmp_path):
    spark.range(9_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(-1)).alias("doc_id")).write.parquet(str(tmp_path / "in"))
    done = shuffle_into_shards(spark.read.parquet(str(tmp_path / "in")), ["doc_id"], 7, 1, bucket_bytes=25_600).withColumn("task", F.spark_partition_id()).collect()
    assert len(done) == 9_000 and max(collections.Counter(r["task"] for r in done).values()) < 400
    assert sorted((r["shard"], r["slot"]) for r in done) == sorted((s, k) for s in range(7) for k in range(1286 if s < 5 else 1285))


def test_op8_contract(spark, nasty, tmp_path):
    nasty.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op8_two_pass_shuffle(spark, str(tmp_path)).collect()
    assert len(rows) == nasty.count()
    texts = collections.defaultdict(set)
    for r in nasty.collect():
        data = (r["text"] or "").encode()
        texts[r["doc_id"]].add((len(data) + 16, zlib.crc32(data)))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_op8_writes_whole_documents(spark, nasty, no_documents, tmp_path, monkeypatch):
    from lumenframe.llm import sharding

    nasty.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(sharding, "shared_dir", lambda spark: str(tmp_path / "out"))
    rows = op8_two_pass_shuffle(spark, str(tmp_path)).collect()
    written = spark.read.parquet(str(tmp_path / "out-shards"))
    names = ("doc_id", "text", "lang", "source", "n_chars")
    assert as_rows(written, *names) == as_rows(nasty, *names)
    found = [(r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in written.collect()]
    assert sorted(found, key=repr) == sorted([tuple(r[n] for n in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in rows], key=repr)
    no_documents.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    monkeypatch.setattr(sharding, "shared_dir", lambda spark: str(tmp_path / "nothing"))
    assert op8_two_pass_shuffle(spark, str(tmp_path / "none")).count() == 0
