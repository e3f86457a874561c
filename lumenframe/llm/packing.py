"""Packing of tokenised documents into sequences by bin completion.

Piece lengths are whole numbers up to the capacity, so a corpus of any size is a histogram of
at most ``capacity`` entries. The driver completes bins on it: around the largest remaining
length it enumerates undominated fillings, best fit first, pruned by the waste that the best
ones so far leave; a filling is repeated as often as the histogram allows. The first descent
is the incumbent; where it misses the lower bound, branch and bound goes on over other fillings
of the whole histogram, and leaves a branch as soon as its waste allows no better result.
The plan is joined to the pieces by length and rank among equal lengths.

Defined results: null texts are empty; an empty text is its end token alone; equal rows are
packed each for itself; of pieces of one length any may take a place; very long texts are cut
into pieces, which may lie in different sequences; an empty table gives an empty plan; other
columns of documents don't matter, those of items stay as they are, whatever their names.
Strings of special tokens in a text are these tokens, as the tokenizer's file has it.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted, stored, table

CAPACITY, END_TOKEN = 2048, 0
#: Limits of the search, which is exponential in the worst case: tried items within one filling, fillings of one bin that are branched to, and bins tried after the first result.
FILLING_NODES, BRANCHES, BIN_NODES = 4_000, 4, 300
#: Bytes of token ids that a task holds before it passes them on.
HELD_BYTES = 8 << 20


# Tokens


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE file. Ids that follow the merges' order are found by a faster library; others, texts it refuses and texts that hold an added token's string, by the file's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        #: Bytes of an id while pieces are stored and shuffled.
        self.width = 2 if max(self.plain.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.added: list[str] = []
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        self.added = sorted(special)
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        order = [vocabulary[m.replace(" ", "", 1)] for m in merges]
        before = spec.get("pre_tokenizer") or {}
        if order != sorted(order) or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model.get("ignore_merges"):
            return None
        ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}
        if len({len(t) for t in ranks if len(t) == 1}) == 0 or sum(len(t) == 1 for t in ranks) != 256 or set(ranks.values()) != set(range(len(ranks))):
            return None
        # Fixed value: the pattern by which byte-level pre-tokenizers cut texts.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is not None and not any(x in text for x in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the library's panics on extreme texts aren't of class Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.plain.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: full ones, but for the first."""
    n, start = len(ids), 0
    length = n % capacity or min(n, capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned numbers, of 16 bits if the vocabulary allows; see widened()."""
    if end_token >= 1 << 16 and encoder(tokenizer).width == 2:
        raise ValueError("the end token is not in the vocabulary")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES.types)], schema=PIECES)

    def rows(batches):
        encode, out, held = encoder(tokenizer), [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(x), end_token], f"<u{encode.width}")
                out += [(i, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cut(ids, capacity))]
                held += ids.nbytes + 64
                if held > HELD_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    return docs.select(quoted(ident).cast("long"), quoted(text)).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids binary")


# Bin completion


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: the best over thresholds a of items that exclude each other, plus what the rest must spill."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    many, mass = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * np.arange(capacity + 1))))
    half, a = capacity // 2 + 1, np.arange(capacity // 2 + 1)
    top = capacity - a + 1
    large, middle = many[-1] - many[top], many[top] - many[half]
    small, room = mass[half] - mass[a], middle * capacity - (mass[top] - mass[half])
    return int(max(-(-mass[-1] // capacity), (large + middle + np.maximum(0, -(-(small - room) // capacity))).max()))


def fillings(counts: dict[int, int], room: int, nodes: int = FILLING_NODES, keep: int = BRANCHES) -> list[tuple[int, ...]]:
    """Undominated fillings of a room, fullest first: larger items first, and nothing is tried that can't leave less waste than the best ``keep`` do.

    A filling is dominated if an item outside it fits in the place of a smaller one.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    left = [counts[s] for s in sizes]
    most = np.cumsum([0, *(s * n for s, n in zip(sizes[::-1], left[::-1]))])[::-1].tolist()  # what the sizes from a place on can fill
    found: list[tuple[int, tuple[int, ...]]] = []
    tried = 0

    def dominated(items: list[int], waste: int) -> bool:
        if not waste:
            return False
        used = Counter(items)
        return any(0 < s - i <= waste and used.get(s, 0) < counts[s] for i in used for s in sizes)

    def bound() -> int:
        return found[-1][0] if len(found) == keep else room + 1

    # Depth first with an own stack, as a room may take as many items as it has tokens. resume: where each item's successors go on; fits: whether it had any.
    items: list[int] = []
    placed: list[int] = []
    resume, fits, room_left = [0], [False], room
    while resume:
        stop = found and (tried >= nodes or (found[0][0] == 0 and len(found) == keep))
        k = resume[-1]
        while k < len(sizes) and (sizes[k] > room_left or not left[k]):
            k += 1
        if k < len(sizes) and len(found) == keep and room_left - most[k] >= bound():
            k, fits[-1] = len(sizes), True  # all that is left can't waste less
        if k < len(sizes) and not stop:
            resume[-1], fits[-1] = k + 1, True
            tried += 1
            left[k] -= 1
            placed.append(k)
            items.append(sizes[k])
            room_left -= sizes[k]
            resume.append(k)
            fits.append(False)
            continue
        if not stop and not fits[-1] and room_left < bound() and not dominated(items, room_left):
            found.append((room_left, tuple(items)))
            found.sort(key=lambda x: (x[0], len(x[1])))
            del found[keep:]
        resume.pop()
        fits.pop()
        if placed:
            left[placed.pop()] += 1
            room_left += items.pop()
        if items and found and found[0][0] == 0:
            resume[-1] = len(sizes)  # a perfect filling: alternatives only by the first item
    return [items for _, items in found] or [()]


Pattern = tuple[int, tuple[int, ...]]


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = BIN_NODES) -> list[Pattern]:
    """Patterns of lengths with repetitions that use up the histogram: the best that branch and bound finds within its limits."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = {s: n for s, n in counts.items() if n}
    bound, best, used, tried = lower_bound(left, capacity), None, 0, 0
    path: list[Pattern] = []
    result: list[Pattern] = []

    def place(pattern: Pattern, times: int) -> None:
        for s, n in Counter(pattern[1]).items():
            left[s] = left.get(s, 0) - n * times
            if not left[s]:
                del left[s]

    def choices() -> Iterator[Pattern]:
        """Fillings around the largest length left, repeated as often as they can be. ``left`` is alike at each call."""
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        first = fillings(rest, capacity - largest, keep=1)[0]
        times = {}
        for fill in (first, None):
            for items in [first] if fill is not None else [f for f in fillings(rest, capacity - largest) if f != first]:
                times[items] = min(left[s] // n for s, n in Counter((largest, *items)).items())
                yield times[items], (largest, *items)
        if times[first] > 1:
            yield 1, (largest, *first)

    stack = [choices()] if left else []
    while stack:
        step = next(stack[-1], None) if best is None or (best > bound and tried < nodes) else None
        if step is None:
            stack.pop()
            if path:
                used -= path[-1][0]
                place(path[-1], -path.pop()[0])
            continue
        tried += best is not None
        path.append(step)
        used += step[0]
        place(step, step[0])
        if not left and (best is None or used < best):
            best, result = used, list(path)
        if not left or (best is not None and used + lower_bound(left, capacity) >= best):
            used -= step[0]
            place(path.pop(), -step[0])
            continue
        stack.append(choices())
    return result


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The rows with sequence_id and offset. Items must be stored: they are read more than once and must be alike each time."""
    counts = {r[0]: r[1] for r in items.groupBy(quoted(length)).count().collect()}  # at most ``capacity`` rows
    plan, seen, first = [], Counter(), 0
    for times, use in complete_bins(counts, capacity):
        at = 0
        for s, n in Counter(use).items():
            plan.append((s, seen[s], seen[s] + n * times, n, first, at))
            seen[s] += n * times
            at += n * s
        first += times
    spark = items.sparkSession
    sequence, offset = fresh(items.columns, "sequence_id", "offset")
    of, low, high, each, number, at, chunk, in_chunk, chunk_length, of_chunk, before, rank = fresh([*items.columns, sequence, offset], "plan_length", "low", "high", "each", "number", "at", "chunk", "in_chunk", "chunk_length", "of_chunk", "before", "rank")
    # The plan's size is bounded by the capacity: each pattern lowers min(count, capacity // length) of one of its lengths, and holds few lengths.
    steps = spark.createDataFrame(plan or [(0, 0, 0, 1, 0, 0)], ", ".join(f"{c} long" for c in (of, low, high, each, number, at)))
    # Ranks among equal lengths in two steps, so that a length with very many items is spread over chunks. Rows are shuffled once, to their chunk.
    chunks = max(64, sum(counts.values()) // 1_000_000)
    own = [quoted(c) for c in items.columns]
    chunked = items.withColumn(chunk, F.pmod(F.xxhash64(*own), F.lit(chunks)))
    sizes = chunked.groupBy(quoted(length).alias(chunk_length), quoted(chunk).alias(of_chunk)).agg(F.count("*").alias(rank))
    earlier = Window.partitionBy(chunk_length).orderBy(of_chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(chunk_length, of_chunk, F.coalesce(F.sum(rank).over(earlier), F.lit(0)).alias(before))
    ranked = chunked.withColumn(in_chunk, F.row_number().over(Window.partitionBy(quoted(length), chunk).orderBy(*own)) - 1)
    joined = ranked.join(offsets, (quoted(length) == F.col(chunk_length)) & (F.col(chunk) == F.col(of_chunk))).withColumn(rank, F.col(in_chunk) + F.col(before))
    joined = joined.join(F.broadcast(steps), (quoted(length) == F.col(of)) & (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high)))
    place = F.col(rank) - F.col(low)
    return joined.select(
        *own,
        (F.col(number) + F.floor(place / F.col(each))).cast("long").alias(sequence),
        (F.col(at) + F.pmod(place, F.col(each)) * quoted(length)).cast("long").alias(offset),
    )


def widened(packed: DataFrame, width: int) -> DataFrame:
    """The same rows with ids as little-endian unsigned 32-bit numbers, and their CRC-32 as ids_crc32."""
    at = packed.columns.index("ids")
    names = [*packed.columns, *fresh(packed.columns, "ids_crc32")]

    def rows(batches):
        for batch in batches:
            wide = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column(at).to_pylist()]
            columns = [pa.array(wide, pa.binary()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.crc32(x) for x in wide], pa.int64())], names=names)

    return packed.mapInArrow(rows, T.StructType([*packed.schema, T.StructField(names[-1], T.LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces: each sequence's token ids, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset, ids_crc32) of every piece."""
    return widened(pack(stored(pieces(docs, tokenizer, capacity=capacity), "pieces"), capacity), encoder(tokenizer).width)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
