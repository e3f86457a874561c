"""Suffix-array deduplication: removal of byte strings that also start in a document with a smaller id.

A sparse, distributed suffix array. Of the suffixes that start in a window of the wanted
length, one is its anchor: the one whose leading bytes have the least hash. So equal windows
have equal anchors, and a run of windows with one anchor is a short string around it.

1. Each group of documents sends the hashes of its anchors' leading bytes; those met in two
   documents are returned. No window with another anchor can match (a filter without loss).
2. Runs with such anchors are range-partitioned by the anchor's leading bytes; the splitters
   are quantiles of a sample. Equal strings of a group are sent once, with the least id. In
   large corpora each range is divided again, by the anchors' hashes.
3. A bucket sorts the runs by multikey quicksort, eight bytes a step, and compares neighbours.
   Where an anchor has several different runs, their windows are sorted likewise; so each
   window gets the least id that has it. Equal leading bytes never straddle a splitter.
4. A bit for each window returns to the group, which removes the covered bytes.

Defined results: matches never cross documents; null text is empty; a null id counts as
larger than all others; rows with equal ids don't remove each other's bytes; texts shorter
than the window stay whole; very long texts are handled whole, in slices that overlap; an empty
table gives an empty table; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, fresh, table
from .packed import FAN, KEYS, Dealing, KeySet, bucket_slices, distinct, distinct_counts, exchange_keys, expand, member, pack, squeeze, unpack

#: Length of the strings, of the anchors' leading bytes, and window starts handled at once.
LENGTH, LEADING, SLICE = 50, 16, 1 << 20
#: Splitters are quantiles of the anchors of about so many documents.
SAMPLE_DOCS = 1_000
#: Least bytes of text in a group, and text for each bucket.
GROUP_BYTES = 4 << 20
#: Window strings sorted at once (a bucket's runs are taken in parts that end where the leading bytes change).
SORTED_AT_ONCE = 1 << 20
LAST = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def big_endian(data: np.ndarray) -> np.ndarray:
    """At each byte the number that it and the next seven make; the data are followed by seven zeros."""
    x = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] << np.uint64(8 * width) | x[width:]
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Corpus:
    """The texts of a group in one buffer, in a defined order."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        raw = [t or b"" for t in texts]
        keys = [LAST if i is None else i for i in ids]
        self.order = sorted(range(len(raw)), key=lambda k: (keys[k], raw[k]))
        self.texts = [raw[k] for k in self.order]
        self.ids = np.array([keys[k] for k in self.order], np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def anchor_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits, of which the upper 40 are an anchor's key, from its sixteen leading bytes as two numbers."""
    h = first * _A
    h ^= (second + _A) * _B
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


class Ranges:
    """Buckets of anchors: ranges of leading bytes between sampled splitters, each divided by the anchors' hashes."""

    def __init__(self, splitters: np.ndarray, fine: int = 1):
        self.splitters, self.fine = splitters, fine

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        both = np.ascontiguousarray(np.stack((first, second), 1).astype(">u8")).view(f"V{LEADING}").reshape(-1)
        found = np.searchsorted(self.splitters, both.view(f"S{LEADING}"), side="right") if len(self.splitters) else np.zeros(len(first), np.int64)
        return found * self.fine + (anchor_hash(first, second) >> np.uint64(24)).astype(np.int64) % self.fine


class Runs:
    """Runs of windows with one anchor: 40-bit hash of its leading bytes, first window, number of windows, place of the anchor, document."""

    def __init__(self, corpus: Corpus, length: int):
        self.corpus, self.length = corpus, length
        parts = list(self._slices())
        self.key, self.first, self.count, self.anchor, self.doc = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)

    def _slices(self) -> Iterator[tuple[np.ndarray, ...]]:
        data, length, low = self.corpus.data, self.length, np.uint64((1 << 24) - 1)
        for at in range(0, len(data) - length + 1, SLICE):
            part = data[at : at + SLICE + length - 1]
            eight = big_endian(part)
            h = anchor_hash(eight[: len(part) - LEADING + 1], eight[8 : len(part) - LEADING + 9])
            h &= ~low
            h |= np.arange(len(h), dtype=np.uint64)
            least = sliding_min(h, length - LEADING + 1)
            doc = self.corpus.doc[at : at + len(least)]
            inside = np.flatnonzero(doc == self.corpus.doc[at + length - 1 : at + length - 1 + len(least)])
            if not len(inside):
                continue
            least, doc = least[inside], doc[inside]
            new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1))))
            least = least[new]
            yield least >> np.uint64(24), inside[new] + at, np.diff(new, append=len(inside)), (least & low).astype(np.int64) + at, doc[new].astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and which of them several documents have."""
        pairs = distinct(self.key << np.uint64(24) | self.doc.astype(np.uint64))
        keys, counts = distinct_counts(pairs >> np.uint64(24))
        return keys, counts > 1

    def leading(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors' first and second eight bytes, as numbers."""
        where = self.anchor[:, None] + np.arange(LEADING)
        both = np.ascontiguousarray(self.corpus.data[where]).view(">u8").reshape(-1, 2).astype(np.uint64)
        return both[:, 0], both[:, 1]


def string_words(eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> list[np.ndarray]:
    """Strings of at most 2 * length - LEADING bytes as columns of eight-byte words, with zeros after their ends."""
    words = []
    for at in range(0, 2 * length - LEADING, 8):
        spare = np.clip(at + 8 - sizes, 0, 8).astype(np.uint64) * np.uint64(8)
        word = eight[np.minimum(starts + at, len(eight) - 1)]
        words.append(np.where(spare < 64, word >> np.minimum(spare, np.uint64(56)) << np.minimum(spare, np.uint64(56)), np.uint64(0)))
    return words


def runs_of_strings(starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> bytes:
    where = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return data[where].tobytes()


class SharedRuns:
    """A group's runs whose anchors are shared, and their distinct strings in an order that only the content decides: by bucket, then as texts."""

    def __init__(self, runs: Runs, shared: np.ndarray, ranges: Ranges):
        corpus, length = runs.corpus, runs.length
        use = np.flatnonzero(member(runs.key, shared))
        self.corpus, self.first, self.count, self.doc = corpus, runs.first[use], runs.count[use], runs.doc[use]
        self.sizes, self.places = self.count + length - 1, runs.anchor[use] - self.first
        runs.anchor = runs.anchor[use]
        self.bucket = ranges.of(*runs.leading())
        columns = [[] for _ in range(0, 2 * length - LEADING, 8)]
        for at in range(0, len(corpus.data), SLICE):  # the runs ascend
            low, high = np.searchsorted(self.first, (at, at + SLICE))
            if low < high:
                eight = big_endian(corpus.data[at : at + SLICE + 2 * length])
                for out, word in zip(columns, string_words(eight, self.first[low:high] - at, self.sizes[low:high], length)):
                    out.append(word)
        words = [np.concatenate([np.zeros(0, np.uint64), *c]) for c in columns]
        order, classes = multikey_sort([self.bucket.astype(np.uint64), *words, self.sizes.astype(np.uint64) << np.uint64(16) | self.places.astype(np.uint64)])
        cuts = np.flatnonzero(np.diff(classes, prepend=-1))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = classes
        self.distinct = order[cuts]
        self.least = np.minimum.reduceat(corpus.ids[self.doc][order], cuts) if len(cuts) else np.zeros(0, np.int64)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        return runs_messages(self.bucket[self.distinct], self.first[self.distinct], self.sizes[self.distinct], self.places[self.distinct], self.least, self.corpus.data)


def runs_messages(bucket: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, ids: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, strings with anchors' places and ids); buckets ascend."""
    for b, part in bucket_slices(bucket) if len(bucket) else ():
        blobs = [pack(sizes[part].astype(np.uint16)), pack(places[part].astype(np.uint16)), pack(ids[part]), squeeze(runs_of_strings(starts[part], sizes[part], data))]
        yield b, b"".join(len(x).to_bytes(4, "big") + x for x in blobs)


class SentRuns:
    """The runs of several messages, one after another."""

    def __init__(self, messages: list[bytes]):
        parts = [blobs_of(x) for x in messages]
        self.each = [unpack(p[0], np.uint16) for p in parts]
        self.sizes, self.places, self.ids = (np.concatenate(c) for c in (self.each, [unpack(p[1], np.uint16) for p in parts], [unpack(p[2], np.int64) for p in parts]))
        self.strings = b"".join(expand(p[3]) for p in parts)

    def apart(self, x: np.ndarray) -> list[np.ndarray]:
        """A value for each run, by message."""
        return np.split(x, np.cumsum([len(s) for s in self.each])[:-1])


class MergedRuns:
    """The distinct runs of several messages, by bucket and then as texts, with their least ids."""

    def __init__(self, sent: SentRuns, length: int, ranges: Ranges):
        sizes, places = sent.sizes.astype(np.int64), sent.places.astype(np.int64)
        starts, self.data = np.cumsum(sizes) - sizes, np.frombuffer(sent.strings, np.uint8)
        eight = big_endian(self.data)
        bucket = ranges.of(eight[starts + places], eight[starts + places + 8])
        order, classes = multikey_sort([bucket.astype(np.uint64), *string_words(eight, starts, sizes, length), sizes.astype(np.uint64) << np.uint64(16) | places.astype(np.uint64)])
        cuts = np.flatnonzero(np.diff(classes, prepend=-1))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = classes
        one = order[cuts]
        self.bucket, self.starts, self.sizes, self.places = bucket[one], starts[one], sizes[one], places[one]
        self.least = np.minimum.reduceat(sent.ids[order], cuts)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        return runs_messages(self.bucket, self.starts, self.sizes, self.places, self.least, self.data)


def blobs_of(message: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(message):
        n = int.from_bytes(message[at : at + 4], "big")
        out.append(message[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def multikey_sort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings given as columns of eight-byte words, and the number of each one's class of equals, in that order.

    Multikey quicksort with a word for a letter: sort by the first, then only within ties by the next.
    """
    order = np.argsort(words[0])
    n = len(order)
    if not n:
        return order, order
    new = np.ones(n, bool)
    new[1:] = words[0][order][1:] != words[0][order][:-1]
    for word in words[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]  # classes of one are ready
        at = np.flatnonzero(tied)
        if not len(at):
            break
        segment = np.cumsum(new)[at]
        inner = np.lexsort((word[order[at]], segment))
        order[at] = order[at][inner]
        value, changed = word[order[at]], np.ones(len(at), bool)
        changed[1:] = (value[1:] != value[:-1]) | (segment[1:] != segment[:-1])
        new[at] |= changed
    return order, np.cumsum(new) - 1


def least_by_class(order: np.ndarray, classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string, in the original order, the least id of its class."""
    least = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(classes, prepend=-1)))
    out = np.empty(len(order), np.int64)
    out[order] = least[classes]
    return out


def compare_runs(sizes: np.ndarray, places: np.ndarray, ids: np.ndarray, strings: bytes, length: int) -> np.ndarray:
    """For each run a bit mask: bit k is set if window k also starts in a document with a smaller id."""
    starts = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))[:-1]))
    eight = big_endian(np.frombuffer(strings, np.uint8))
    anchor = starts + places
    lead = np.stack((eight[anchor], eight[anchor + 8]))
    masks = np.zeros(len(sizes), np.uint64)
    by_lead = np.lexsort((lead[1], lead[0]))
    a, b = lead[0][by_lead], lead[1][by_lead]
    group = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    cuts, edges = [0], np.flatnonzero(np.diff(group, prepend=-1))
    limit = max(1, SORTED_AT_ONCE // (length - LEADING + 1))
    while cuts[-1] < len(group):
        at = np.searchsorted(edges, cuts[-1] + limit)
        cuts.append(int(edges[at]) if at < len(edges) else len(group))
    for low, high in zip(cuts, cuts[1:]):
        rows = by_lead[low:high]
        masks[rows] = compare_part(starts[rows], sizes[rows].astype(np.int64), places[rows].astype(np.int64), ids[rows], group[low:high], eight, length)
    return masks


def compare_part(starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, ids: np.ndarray, group: np.ndarray, eight: np.ndarray, length: int) -> np.ndarray:
    words = string_words(eight, starts, sizes, length)
    order, classes = multikey_sort([*words, sizes.astype(np.uint64) << np.uint64(16) | places.astype(np.uint64)])
    least = least_by_class(order, classes, ids)
    windows = sizes - length + 1
    masks = np.where(least < ids, (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1), np.uint64(0))
    # Anchors with several different strings: their windows are compared one by one, each string once.
    one_of = order[np.flatnonzero(np.diff(classes, prepend=-1))]
    anchor = group - group[0]
    several = np.flatnonzero(np.bincount(anchor[one_of], minlength=anchor[-1] + 1)[anchor[one_of]] > 1)
    if len(several):
        rep = one_of[several]
        count = windows[rep]
        first = np.cumsum(count) - count
        string = np.repeat(np.arange(len(rep)), count)
        at = starts[rep][string] + np.arange(len(string)) - first[string]
        w_order, w_classes = multikey_sort([eight[at + k] for k in (*range(0, length - 8, 8), length - 8)])
        w_least = least_by_class(w_order, w_classes, least[rep][string])
        place = np.full(len(one_of), -1)
        place[several] = np.arange(len(several))
        class_of = np.empty(len(order), np.int64)
        class_of[order] = classes
        rows = np.flatnonzero(place[class_of] >= 0)
        s = place[class_of[rows]]
        n = count[s]
        begin = np.cumsum(n) - n
        bit = np.arange(n.sum()) - np.repeat(begin, n)
        hit = w_least[np.repeat(first[s], n) + bit] < np.repeat(ids[rows], n)
        masks[rows] = np.add.reduceat(hit.astype(np.uint64) << bit.astype(np.uint64), begin)
    return masks


def sample_splitters(docs: DataFrame, text: str, length: int, ranges: int, rows: int) -> np.ndarray:
    """Quantiles of the anchors' leading bytes, over a sample of documents. Anchors with equal leading bytes are in one range."""
    if ranges < 2 or not rows:
        return np.zeros(0, f"S{LEADING}")

    def leads(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            lead = np.stack(Runs(Corpus([0] * len(texts), texts), length).leading(), 1)
            lead = lead[:: max(1, len(lead) // 4096)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lead[:, 0]), pa.array(lead[:, 1])], names=["a", "b"])

    sample = docs.select(text).sample(min(1.0, SAMPLE_DOCS / rows), 23) if rows > SAMPLE_DOCS else docs.select(text)
    found = sample.mapInArrow(leads, "a long, b long").toArrow()
    both = np.stack([found.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in "ab"], 1).astype(">u8")
    lead = np.sort(np.ascontiguousarray(both).view(f"V{LEADING}").reshape(-1).view(f"S{LEADING}"))
    return np.unique(lead[np.arange(1, ranges) * len(lead) // ranges]) if len(lead) else lead


def removed_bytes(docs: DataFrame, ident: str, text: str, length: int, finish, schema: T.StructType, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> DataFrame:
    """What ``finish`` makes of each group: it gets the group's rows (as read), its Corpus and for each byte whether it is removed, and returns an Arrow table."""
    if not LEADING + 8 <= length <= LEADING + 63:
        raise ValueError(f"length must be from {LEADING + 8} to {LEADING + 63}")
    group = fresh(docs.columns, "group")[0]
    rows, total, groups = dealt(docs, [ident, text], text, group, group_bytes)
    dealing = Dealing(groups, max(8, total // max(group_bytes, total // groups)), fan)
    splitters = sample_splitters(docs, text, length, dealing.coarse, docs.count() if total else 0)
    ranges, finer = Ranges(splitters), Ranges(splitters, dealing.fine)
    id_at, text_at, group_at = rows.columns.index(ident), rows.columns.index(text), rows.columns.index(group)

    def corpus_of(t: pa.Table) -> Corpus:
        return Corpus(t.column(id_at).to_pylist(), t.column(text_at).cast(pa.binary()).to_pylist())

    def number_of(*tables: pa.Table) -> int:
        return next(t.column(at)[0].as_py() for t, at in zip(tables, (group_at, 0)) if t.num_rows)

    def keys_of(runs: Runs) -> KeySet:
        return KeySet(*runs.anchors(), dealing.coarse)

    def send_anchors(t: pa.Table) -> pa.Table:
        return keys_of(Runs(corpus_of(t), length)).message(number_of(t))

    def shared_runs(corpus: Corpus, answers: pa.Table) -> SharedRuns:
        runs = Runs(corpus, length)
        return SharedRuns(runs, keys_of(runs).shared(answers), ranges)

    def messages_of(found: Iterator[tuple[int, bytes]], sender: int) -> pa.Table:
        out = list(found)
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "sender": pa.array([sender] * len(out), pa.int64()), "runs": pa.array([x[1] for x in out], pa.binary())})

    def send_runs(t: pa.Table, answers: pa.Table) -> pa.Table:
        return messages_of(shared_runs(corpus_of(t), answers).messages() if t.num_rows else iter(()), number_of(t, answers))

    def masks_of(t: pa.Table, sent: SentRuns, masks: np.ndarray) -> pa.Table:
        return pa.table({"receiver": t.column("sender"), "bucket": t.column("bucket"), "masks": pa.array([pack(x) for x in sent.apart(masks)], pa.binary())})

    def compare(t: pa.Table) -> pa.Table:
        sent = SentRuns(t.column("runs").to_pylist())
        return masks_of(t, sent, compare_runs(sent.sizes, sent.places, sent.ids, sent.strings, length))

    def merge(t: pa.Table, node: int) -> pa.Table:
        return messages_of(MergedRuns(SentRuns(t.column("runs").to_pylist()), length, finer).messages(), node)

    def split(t: pa.Table, told: pa.Table) -> pa.Table:
        sent = SentRuns(t.column("runs").to_pylist())
        merged = MergedRuns(sent, length, finer)
        masks = np.concatenate([unpack(x, np.uint64) for x in told.column("masks").to_pylist()])[merged.entry]
        full = (np.uint64(1) << (sent.sizes - np.uint16(length - 1)).astype(np.uint64)) - np.uint64(1)
        return masks_of(t, sent, np.where(sent.ids > merged.least[merged.entry], full, masks))

    def remove(t: pa.Table, both: pa.Table) -> pa.Table:
        corpus = corpus_of(t)
        starts = np.zeros(len(corpus.data) + 1, np.int8)
        answers = both.filter(pc.is_valid(both.column("masks"))).sort_by("bucket")
        if answers.num_rows:
            runs = shared_runs(corpus, both.filter(pc.is_valid(both.column("bits"))))
            masks = np.concatenate([unpack(x, np.uint64) for x in answers.column("masks").to_pylist()])[runs.entry]
            full = (np.uint64(1) << runs.count.astype(np.uint64)) - np.uint64(1)
            masks = np.where(corpus.ids[runs.doc] > runs.least[runs.entry], full, masks)
            for k in range(int(runs.count.max())):
                hit = (masks >> np.uint64(k) & np.uint64(1)).astype(bool)
                starts[runs.first[hit] + k] = 1
        change = np.zeros(len(corpus.data) + length, np.int8)
        change[: len(starts)] += starts
        change[length:] -= starts[: len(corpus.data)]
        return finish(t, corpus, np.cumsum(change, dtype=np.int16)[: len(corpus.data)] > 0)

    shared = exchange_keys(rows.groupBy(group).applyInArrow(send_anchors, KEYS), dealing)
    runs = rows.groupBy(group).cogroup(shared.groupBy("receiver")).applyInArrow(send_runs, "bucket long, sender long, runs binary")
    masks = dealing.exchange(runs, "bucket long, sender long, runs binary", "receiver long, bucket long, masks binary", compare, merge, split)
    none = F.lit(None).cast("binary")
    both = shared.select("receiver", "bucket", "bits", none.alias("masks")).unionAll(masks.select("receiver", "bucket", none.alias("bits"), "masks"))
    return rows.groupBy(group).cogroup(both.groupBy("receiver")).applyInArrow(remove, schema)


def kept_parts(corpus: Corpus, removed: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row as read, text in bytes, removed) of each document."""
    for k, end in enumerate(corpus.ends.tolist()):
        yield corpus.order[k], corpus.texts[k], removed[end - len(corpus.texts[k]) : end]


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns, the text without the repeated bytes; characters of which only some bytes are left go too."""
    names, at = docs.columns, docs.columns.index(text)

    def finish(t: pa.Table, corpus: Corpus, removed: np.ndarray) -> pa.Table:
        texts = t.column(at).to_pylist()
        for row, data, gone in kept_parts(corpus, removed):
            if gone.any():
                texts[row] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        columns = [pa.array(texts, t.column(at).type) if k == at else t.column(k) for k in range(len(names))]
        return pa.table(columns, names=names)

    return removed_bytes(docs, ident, text, length, finish, docs.schema)


def repeat_digests(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    at = docs.columns.index(ident)

    def finish(t: pa.Table, corpus: Corpus, removed: np.ndarray) -> pa.Table:
        ids, out = t.column(at).to_pylist(), []
        for row, data, gone in kept_parts(corpus, removed):
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            kept = np.frombuffer(data, np.uint8)[~gone] if spans else data
            out.append((ids[row], len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        columns = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return removed_bytes(docs, ident, text, length, finish, schema, group_bytes, fan)


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return repeat_digests(docs)
