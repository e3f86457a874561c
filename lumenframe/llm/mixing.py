"""Mixing of sources to target weights by Poisson replication, with DataFrame operations only.

A source of n rows that shall make up the share w of T rows gets the rate w * T / n. Each
row draws a Poisson count with that mean by inversion of a seeded hash of its keys, is
repeated that often, and all copies are shuffled globally by another hash. A high rate is
drawn in parts, as sums of Poisson counts are Poisson: so the table that a draw is inverted
in stays short whatever the rate.

Defined results: a null source is a source of its own; null keys hash like any value; rows
with equal keys draw alike; texts of any length are only copied; sources without a target
weight get rate 0; an empty table gives an empty table; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, table

#: Highest rate of one draw; its table has PART_RATE + 12 * sqrt(PART_RATE) + 30 numbers at most.
PART_RATE = 32.0
#: Up to so many bytes of rates, by sources and their names, the table of rates is broadcast; beyond, rows and rates meet by a salted join.
BROADCAST_BYTES, RATE_BYTES = 8 << 20, 1_200
SALTS = 64


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a seeded MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\0")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the tail is far below 2^-52, of a rate of at most PART_RATE."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + p)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def poisson_count(cdf: Column, parts: Column, seed: int, keys: list[Column]) -> Column:
    """The sum of as many draws as there are parts, each the number of entries of the table up to its hash. The first hash is of the seed and the keys alone."""

    def draw(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda p: p <= u)).cast("long")

    first = draw(unit_hash(seed, *keys))
    others = F.aggregate(F.sequence(F.lit(1).cast("long"), parts - 1), F.lit(0).cast("long"), lambda n, j: n + draw(unit_hash(seed, *keys, j)))
    return F.when(parts > 1, first + others).otherwise(first)


def source_rates(df: DataFrame, source: str, weights: dict | None = None, temperature: float = 0.5, target_rows: int | None = None) -> tuple[DataFrame, int]:
    """A row for each source: its rows ``n``, target share ``weight`` and ``rate``; and a bound on the bytes of their table. Without weights, shares go as n to the power temperature."""
    counts = df.groupBy(quoted(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        total = float(sum(weights.values()))
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(w / total)).otherwise(raw)
    counts = counts.withColumn("raw", raw)
    raws, rows, size = counts.agg(F.sum("raw"), F.sum("n"), F.sum(RATE_BYTES + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)))).first()
    target = float(target_rows if target_rows is not None else rows or 0)
    weight = F.col("raw") / F.lit(float(raws)) if raws else F.lit(0.0)
    return counts.select("source", "n", weight.alias("weight"), (weight * target / F.col("n")).alias("rate")), size or 0


def mix_sources(df: DataFrame, source: str, keys: list[str], weights: dict | None = None, temperature: float = 0.5, target_rows: int | None = None, seed: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, each as often as its Poisson count says, in shuffled order, with ``copy`` (from 1) and ``shuffle_key`` (rows of a partition ascend by it)."""
    copy, order = fresh(df.columns, "copy", "shuffle_key")
    own_source, own_cdf, own_parts, own_salt, row_salt = fresh([*df.columns, copy, order], "source_of_rate", "cdf", "parts", "salt", "row_salt")
    table_of_rates, size = source_rates(df, source, weights, temperature, target_rows)
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("long")
    rates = table_of_rates.withColumn(own_parts, parts).select(F.col("source").alias(own_source), own_parts, poisson_cdf(F.col("rate") / quoted(own_parts)).alias(own_cdf))
    matched = quoted(source).eqNullSafe(quoted(own_source))
    if size <= broadcast_bytes:
        joined = df.join(F.broadcast(rates), matched)
    else:
        salted = rates.withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn(row_salt, F.pmod(F.xxhash64(*[quoted(k) for k in keys]), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, matched & (quoted(row_salt) == quoted(own_salt)))
    count = poisson_count(quoted(own_cdf), quoted(own_parts), seed, [quoted(k) for k in keys])
    columns = [quoted(c) for c in df.columns]
    copies = joined.select(*columns, F.explode(F.when(count > 0, F.sequence(F.lit(1), count.cast("int")))).alias(copy))
    key = (unit_hash(seed + 1, *[quoted(k) for k in keys], quoted(copy)) * float(1 << 52)).cast("long")
    return copies.withColumn(order, key).repartition(order).sortWithinPartitions(order)


#: Production parameters of the query and of the pipeline.
SEED, TEMPERATURE = 7, 0.5


def op4_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), "source", ["doc_id"], temperature=TEMPERATURE, seed=SEED)


OP4_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) AS w FROM counts),
rates AS (SELECT source, w * (SELECT sum(n) FROM counts) / n AS rate FROM weights),
parted AS (SELECT source, CAST(greatest(ceil(rate / 32.0), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / 32.0), 1) AS rate FROM rates),
steps AS (SELECT source, rate, k, CASE WHEN k = 0 THEN 0.0 ELSE ln(k) END AS log_k
          FROM parted, (SELECT unnest(range(0, 400)) AS k) ks),
terms AS (SELECT source, k, exp(k * ln(rate) - rate - sum(log_k) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (SELECT d.doc_id, d.source, unnest(range(0, parts)) AS j FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source),
hashes AS (SELECT doc_id, source, CAST('0x' || substr(md5('7|' || doc_id || CASE WHEN j = 0 THEN '' ELSE '|' || j END), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM draws),
repeats AS (SELECT h.doc_id, h.source, count(*) AS n FROM hashes h JOIN cdf c ON h.source IS NOT DISTINCT FROM c.source AND c.c <= h.u GROUP BY h.doc_id, h.source),
copies AS (SELECT d.*, unnest(range(1, r.n + 1)) AS copy FROM documents d JOIN repeats r ON d.doc_id = r.doc_id AND d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('8|' || doc_id || '|' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM copies
"""
