"""Two-pass external shuffle into shards, with DataFrame operations only.

Pass one scatters the rows by a seeded hash into buckets of bounded size, each in a task of
its own; pass two shuffles each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates) and
writes it. The position of a row is its bucket's offset plus its place in the bucket; shards
are equal stretches of positions, so their counts differ by one row at most, rows of a bucket
fall into few shards, and many tasks write one shard.

Defined results: null keys hash like any value; rows with equal keys and values are placed
one by one; a row larger than a bucket makes its bucket as large as needed; if rows with
equal keys make a bucket far too large, the rows' places in the input join the hash (the input
must then be stored, so that it reads alike each time); an empty table gives empty shards;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh, quoted, shared_dir, table, utf8_size

#: Payload bytes of a bucket, by expectation; a task holds one bucket at a time.
BUCKET_BYTES = 32 << 20
#: A bucket of so many times the expected bytes, beyond its largest row, has rows with equal keys.
UNEVEN = 4


def _scattered(df: DataFrame, hashed: list[Column], weight: Column, seed: int, bucket_bytes: int, uneven: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(bucket, item: h and row); (bucket, n) of the buckets; their number; the number of rows."""
    total = df.agg(F.sum(weight.cast("double"))).first()[0] or 0.0
    n_buckets = max(1, -int(-total // bucket_bytes))

    def dealt(keys: list[Column]) -> tuple[DataFrame, DataFrame]:
        rows = df.select(
            F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_buckets)).cast("int").alias("bucket"),
            F.struct(F.xxhash64(F.lit(seed + 1), *keys).alias("h"), F.struct(*[quoted(c) for c in df.columns]).alias("row")).alias("item"),
        )
        sized = df.select(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n_buckets)).cast("int").alias("bucket"), weight.alias("w"))
        return rows, sized.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("w").alias("bytes"), F.max("w").alias("largest"))

    rows, buckets = dealt(hashed)
    n, crowded = buckets.agg(F.sum("n"), F.max(F.col("bytes") - F.col("largest"))).first()
    if n_buckets > 1 and crowded > uneven * bucket_bytes:
        rows, buckets = dealt([*hashed, F.monotonically_increasing_id()])
    return rows, buckets, n_buckets, n or 0


def shuffle_into_shards(df: DataFrame, keys: list[str], n_shards: int, seed: int, size: str | None = None, bucket_bytes: int = BUCKET_BYTES, uneven: int = UNEVEN) -> DataFrame:
    """All rows and columns, with ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard); each partition holds a bucket.

    keys: columns whose values the scattering hash reads; they should tell rows apart.
    size: column of each row's payload bytes; without it a row counts as 256 bytes.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 at least")
    shard, slot = fresh(df.columns, "shard", "slot")
    weight = F.coalesce(quoted(size), F.lit(0)) if size else F.lit(256)
    rows, sizes, n_buckets, n = _scattered(df, [quoted(k) for k in keys], weight, seed, bucket_bytes, uneven)
    first = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one short row for each bucket
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(first), F.lit(0)).cast("long").alias("offset")).repartitionById(n_buckets, F.col("bucket"))
    # Buckets and their rows are put in order first, so that a task that runs again shuffles alike.
    # Whole rows go to their bucket's task before they are gathered: mappers would otherwise gather all of their input.
    buckets = rows.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    placed = (
        buckets.join(offsets, "bucket")
        .sortWithinPartitions("bucket")
        .select("offset", F.shuffle("items", seed).alias("items"))
        .select("offset", F.posexplode("items").alias("place", "item"))
        .select("item.row", (F.col("offset") + F.col("place")).alias("at"))
    )
    # Shards are stretches of positions; the first ones have one row more.
    base, longer = divmod(n, n_shards)
    at, edge = F.col("at"), longer * (base + 1)
    whole = lambda x, by: F.call_function("div", x, F.lit(max(by, 1)).cast("long"))
    early = at < edge
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns],
        F.when(early, whole(at, base + 1)).otherwise(longer + whole(at - edge, base)).cast("int").alias(shard),
        F.when(early, F.pmod(at, F.lit(base + 1).cast("long"))).otherwise(F.pmod(at - edge, F.lit(max(base, 1)).cast("long"))).cast("long").alias(slot),
    )


def write_shards(df: DataFrame, path: str, keys: list[str], n_shards: int, seed: int, size: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards as Parquet, a folder each. A bucket's task writes its own rows, so a shard has as many files as buckets meet it, each with ascending slots."""
    done = shuffle_into_shards(df, keys, n_shards, seed, size, bucket_bytes)
    shard, slot = done.columns[-2:]
    done.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """The rows of written shards: the columns, then slot and shard."""
    shard, slot = fresh(columns.fieldNames(), "shard", "slot")
    return spark.read.schema(StructType([*columns, StructField(slot, LongType()), StructField(shard, IntegerType())])).parquet(path)


def op8_two_pass_shuffle(spark, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled and written as shards; the digests are those of the documents read from there."""
    docs = table(spark, sf_dir, "documents")
    size = fresh(docs.columns, "size")[0]
    docs = docs.withColumn(size, utf8_size(F.col("text")) + 16)
    path = f"{shared_dir(spark)}-shards"
    write_shards(docs, path, ["doc_id", "text"], n_shards=40, seed=20240501, size=size)
    shards = read_shards(spark, path, docs.schema)
    slot, shard = shards.columns[-2:]
    return shards.select(
        "doc_id",
        (utf8_size(F.col("text")) + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        quoted(shard).alias("shard"),
        quoted(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
