"""Arrays of numbers as compressed bytes, and exchanges of them between groups of documents.

A group has messages for many buckets, and a bucket answers each sender. Up to FAN buckets,
messages go straight there. Beyond, buckets are dealt in two levels, so that neither the
number of rows nor what a task holds grows with the square of the input: a node gathers one
coarse bucket's messages of up to FAN groups, merges them, passes the parts on to fine
buckets, and splits the answers for its senders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEVEL = 3
#: Buckets of one level, and groups whose messages a node merges.
FAN = 4_096


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that small numbers take little room."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    raw, width = np.frombuffer(expand(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending values without repeats, by sorting, which is many times as fast as hashing."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(new, append=len(x))


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in an ascending array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def in_several(parts: list[np.ndarray]) -> np.ndarray:
    """Ascending values that stand in at least two of the arrays (each without repeats)."""
    if not parts:
        return np.zeros(0, np.uint64)
    x = np.sort(np.concatenate(parts))
    again = x[1:] == x[:-1]
    return distinct(x[1:][again])


def pack_bits(x: np.ndarray) -> bytes:
    return squeeze(np.packbits(x).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(data), np.uint8), count=n).astype(bool)


def shared_bits(own: list[bytes], several: list[bytes]) -> list[bytes]:
    """For each sender's ascending keys (those that it has several times listed again), one bit a key: whether it, or another sender, has it again."""
    keys = [unpack_sorted(x) for x in own]
    shared = distinct(np.concatenate([in_several(keys), *(unpack_sorted(x) for x in several)]))
    return [pack_bits(member(x, shared)) for x in keys]


def bucket_slices(bucket: np.ndarray):
    """(bucket, slice) of the parts of an ascending array of bucket numbers."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), slice(a, b)


class Dealing:
    """How many coarse buckets there are, and fine ones in each, for so many groups and at least so many buckets."""

    def __init__(self, groups: int, buckets: int, fan: int = FAN):
        two = buckets > fan
        self.coarse = min(fan, int(np.ceil(np.sqrt(buckets)))) if two else buckets
        self.fine = -(-buckets // self.coarse) if two else 1
        self.districts = -(-groups // fan)
        self.two_levels = two

    def exchange(self, messages: DataFrame, message_type: str, answer_type: str, answer: Callable[[pa.Table], pa.Table], merge: Callable[[pa.Table, int], pa.Table], split: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        """(receiver, bucket, ...): what ``answer`` makes of each bucket's (bucket, sender, ...), for each sender.

        merge: a node's messages to messages of the node for fine buckets. split: its messages and the answers to it, to answers for its senders.
        """
        if not self.two_levels:
            return messages.groupBy("bucket").applyInArrow(answer, answer_type)
        nodes = messages.withColumn("node", F.col("bucket") * self.districts + F.pmod("sender", F.lit(self.districts))).groupBy("node")
        merged = nodes.applyInArrow(lambda t: merge(t, t.column("node")[0].as_py()), message_type)
        told = merged.groupBy("bucket").applyInArrow(answer, answer_type)
        return nodes.cogroup(told.groupBy("receiver")).applyInArrow(lambda t, told: split(t, told.sort_by("bucket")), answer_type)


# Exchange of 40-bit keys: which of its own does another sender have too?


def range_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)


class KeySet:
    """Ascending distinct keys of a sender, and whether it has each several times."""

    def __init__(self, keys: np.ndarray, several: np.ndarray, buckets: int):
        self.keys, self.several, self.buckets = keys, several, buckets

    @classmethod
    def of(cls, parts: list[np.ndarray], buckets: int) -> KeySet:
        """From parts that have each key once."""
        keys, counts = distinct_counts(np.concatenate([np.zeros(0, np.uint64), *parts]))
        return cls(keys, counts > 1, buckets)

    def parts(self) -> Iterator[tuple[int, slice]]:
        return bucket_slices(range_of(self.keys, self.buckets)) if len(self.keys) else iter(())

    def message(self, sender: int) -> pa.Table:
        out = [(b, pack_sorted(self.keys[part]), pack_sorted(self.keys[part][self.several[part]])) for b, part in self.parts()]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "sender": pa.array([sender] * len(out), pa.int64()), "a": pa.array([x[1] for x in out], pa.binary()), "b": pa.array([x[2] for x in out], pa.binary())})

    def shared(self, answers: pa.Table) -> np.ndarray:
        """The keys that the answers' bits mark."""
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        return np.concatenate([np.zeros(0, np.uint64), *(self.keys[part][unpack_bits(bits[b], part.stop - part.start)] for b, part in self.parts())])


KEYS, BITS = "bucket long, sender long, a binary, b binary", "receiver long, bucket long, bits binary"


def answer_keys(t: pa.Table) -> pa.Table:
    """To each sender's keys in a bucket, which of them another sender, or it again, has."""
    return pa.table({"receiver": t.column("sender"), "bucket": t.column("bucket"), "bits": pa.array(shared_bits(t.column("a").to_pylist(), t.column("b").to_pylist()), pa.binary())})


def exchange_keys(messages: DataFrame, dealing: Dealing) -> DataFrame:
    """Bits for each sender's keys, asked by coarse buckets."""
    buckets = dealing.coarse * dealing.fine

    def merged(t: pa.Table) -> KeySet:
        own = KeySet.of([unpack_sorted(x) for x in t.column("a").to_pylist()], buckets)
        own.several |= member(own.keys, distinct(np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(x) for x in t.column("b").to_pylist())])))
        return own

    def split(t: pa.Table, told: pa.Table) -> pa.Table:
        shared = merged(t).shared(told)
        bits = [pack_bits(member(unpack_sorted(x), shared)) for x in t.column("a").to_pylist()]
        return pa.table({"receiver": t.column("sender"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return dealing.exchange(messages, KEYS, BITS, answer_keys, lambda t, node: merged(t).message(node), split)
