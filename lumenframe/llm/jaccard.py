"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search.

Two sets link if 100 * intersection >= threshold * union.

1. Documents with equal sets are one class; from here on the least id stands for it.
2. With any common order of shingles, linked sets share the first l of those they have in
   common among the first n - ceil(threshold * n) + l of each. Groups of documents send
   theirs (the order is the hash, l a quarter of n); documents with too few of them shared
   with other sets are left out. The sets of those that stay are stored.
3. A linked set shares at least threshold * n shingles with other sets. All shingles of the
   documents left are counted alike, and documents with fewer shared ones go.
4. Shingles met once come first in the order now, so the first ones that are shared are few.
   Each of them has a leader, the least document that has it among its first ones, and each
   document goes to all its leaders: every pair to be tested meets at one. A group names each
   shingle once, so a very common one gathers a row for each group, not for each document.
5. A leader's documents are searched by DivideSkip over inverted lists: the long lists are
   put aside, the short ones heap-merged, and what may still reach the needed overlap is
   probed in the long ones. Pairs that earlier links connect are not searched.
6. A leader with very many documents has several tasks, each with its documents and the
   leader; documents not connected with the leader there are searched in all of them.
7. The links' connected components are found by alternating stars.

Defined results: null text and text without words have an empty set and link with nothing;
a null id links with nothing and has no component; rows with equal ids are one document
with several texts; repeated rows and ties have one class, for which the least id stands; very
long texts are read whole; an empty table gives an empty table; other columns don't matter.

Exact but for hashes: 64 bits stand for a shingle. The filters count shingles by 40 of these
bits, so that some that aren't shared may count as shared: this only lets more through.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, fresh, quoted, stored, table
from .components import components
from .packed import FAN, KEYS, Dealing, KeySet, bucket_slices, distinct, exchange_keys, member, pack, pack_bits, pack_sorted, range_of, unpack, unpack_bits, unpack_sorted

#: Words of a shingle; hundredths of the union that linked sets share.
WORDS, THRESHOLD = 5, 75
#: Documents and shingles that one search task holds.
TASK_DOCS, TASK_SHINGLES = 4_000, 4_000_000
GROUP_BYTES = 4 << 20
#: Classes that at least this share of all rows are in are broadcast with their least id.
HOT_SHARE = 0.001
#: Weight of DivideSkip's rule for the number of long lists.
SKIP_WEIGHT = 0.0085
#: In place of a leader.
NONE = np.iinfo(np.int64).max
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(24)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles. Words are cut at ASCII space, and A-Z are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(n, words)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * _P + w[k : n - width + 1 + k]
    if n < words:
        h = h * _P + np.uint64(n)
    h ^= h >> np.uint64(32)
    h *= _Q
    h ^= h >> np.uint64(29)
    h *= _P
    h ^= h >> np.uint64(32)
    return distinct(h)


def needed(n: int, threshold: int) -> int:
    """Least overlap of a set of n with any that it links with."""
    return -(-threshold * n // 100)


def first_ones(n: int, threshold: int) -> int:
    return n - needed(n, threshold) + 1


def head_common(n: int) -> int:
    """How many common shingles the heads of linked sets are long enough to hold."""
    return max(1, n // 4)


def head(s: np.ndarray, threshold: int) -> np.ndarray:
    """The first shingles, as 40-bit keys, one for each shingle."""
    n = len(s)
    return s[: n - needed(n, threshold) + head_common(n)] >> _HIGH


def linked(a: int, b: int, overlap: int, threshold: int) -> bool:
    return 100 * overlap >= threshold * (a + b - overlap)


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Group:
    """Distinct non-empty sets of a group of documents, each with its least id, in the order of their digests. Ids and sets in ``skip`` are left out."""

    def __init__(self, ids: list[int | None], texts: list[str | None], words: int, skip: set[bytes]):
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        for i, t in zip(ids, texts):
            if i is None:
                continue
            s = shingles(t, words)
            if len(s):
                d = digest_of(s)
                if b"%d|%s" % (i, d) not in skip and (d not in sets or i < sets[d][0]):
                    sets[d] = i, s
        self.sets = [sets[d][1] for d in sorted(sets)]
        self.ids = np.array([sets[d][0] for d in sorted(sets)], np.int64)


# T-occurrence search


class Search:
    """Documents of one task with their inverted lists, and the links found so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], threshold: int):
        self.ids, self.sizes, self.sets, self.threshold = ids, sizes, sets, threshold
        doc = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((doc, key))
        key, self.postings = key[order], doc[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.keys, self.begin, self.end = key[cuts], cuts, np.append(cuts[1:], len(key)) if len(key) else cuts
        #: Of each document, the first of those that it is connected with. Ids ascend.
        self.root = np.arange(len(ids))

    def connect(self, a: int, b: int) -> None:
        a, b = sorted((int(self.root[a]), int(self.root[b])))
        if a != b:
            self.root[self.root == b] = a

    def lists(self, query: np.ndarray, open_docs: np.ndarray) -> list[np.ndarray]:
        """The query's inverted lists, of open documents only."""
        at = np.searchsorted(self.keys, query)
        at = at[at < len(self.keys)] if len(at) and at[-1] >= len(self.keys) else at
        at = at[self.keys[at] == query[: len(at)]]
        size = self.end[at] - self.begin[at]
        where = np.repeat(self.begin[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        docs = self.postings[where]
        use = open_docs[docs]
        of_list = np.repeat(np.arange(len(at)), size)[use]
        docs = docs[use]
        return np.split(docs, np.flatnonzero(np.diff(of_list)) + 1) if len(docs) else []

    def search(self, query: np.ndarray, size: int, open_docs: np.ndarray) -> list[int]:
        """Open documents that the query links with, by DivideSkip."""
        lists = self.lists(query, open_docs)
        least = needed(size, self.threshold)
        if len(lists) < least:
            return []
        lists.sort(key=len)
        longest = len(lists[-1])
        n_long = min(len(lists), least - 1, int(least / (SKIP_WEIGHT * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found = []
        for doc, same in groupby(heapq.merge(*(x.tolist() for x in short))):
            overlap = sum(1 for _ in same)
            if overlap < least - n_long:
                continue
            other = int(self.sizes[doc])
            wanted = -(-self.threshold * (size + other) // (100 + self.threshold))
            rest = n_long
            for x in long:
                if overlap >= wanted or overlap + rest < wanted:
                    break
                at = int(np.searchsorted(x, doc))
                overlap += at < len(x) and int(x[at]) == doc
                rest -= 1
            if overlap >= wanted:
                found.append(doc)
        return found

    def fits(self, size: int) -> np.ndarray:
        """Documents whose size allows a link with a set of this size."""
        return (100 * np.minimum(self.sizes, size) >= self.threshold * np.maximum(self.sizes, size)) if len(self.sizes) else np.zeros(0, bool)

    def all_links(self) -> None:
        """Connect all linked documents. Each searches those after it that aren't connected with it yet."""
        for q in range(len(self.ids)):
            open_docs = self.fits(int(self.sizes[q])) & (self.root != self.root[q])
            open_docs[: q + 1] = False
            if open_docs.any():
                for d in self.search(self.sets[q], int(self.sizes[q]), open_docs):
                    self.connect(q, d)


def find_links(rows: DataFrame, skip: DataFrame, dealing: Dealing, words: int = WORDS, threshold: int = THRESHOLD, task_docs: int = TASK_DOCS, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(u, v): links that connect all classes of documents that links connect.

    rows: (doc_id, text, grp), dealt into groups. skip: (receiver, skipped), ids with digests of group ``receiver`` for which another id stands.
    """

    buckets = dealing.coarse

    def number_of(*tables: pa.Table) -> int:
        return next(t.column(name)[0].as_py() for t, name in zip(tables, ("grp" if "grp" in tables[0].column_names else "sender", "receiver")) if t.num_rows)

    def group_of(t: pa.Table, messages: pa.Table) -> Group:
        skipped = set(messages.column("skipped").drop_null().to_pylist())
        return Group(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), words, skipped)

    def key_set(parts: list[np.ndarray]) -> KeySet:
        return KeySet.of([distinct(x) for x in parts], buckets)

    def heads_of(own: Group) -> list[np.ndarray]:
        return [head(s, threshold) for s in own.sets]

    def send_heads(t: pa.Table, messages: pa.Table) -> pa.Table:
        return key_set(heads_of(group_of(t, messages))).message(number_of(t, messages))

    def keep_left(t: pa.Table, messages: pa.Table) -> pa.Table:
        """The sets of documents with enough of their heads shared."""
        own = group_of(t, messages)
        heads = heads_of(own)
        shared = key_set(heads).shared(messages.filter(pc.is_valid(messages.column("bits"))))
        left = [k for k, h in enumerate(heads) if member(h, shared).sum() >= min(head_common(needed(len(own.sets[k]), threshold)), len(h))]
        return pa.table({"sender": pa.array([number_of(t, messages)] * len(left), pa.int64()), "doc": pa.array(own.ids[left]), "keys": pa.array([own.sets[k].tobytes() for k in left], pa.binary())})

    def left_of(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids and sets, in a defined order."""
        ids, raw = t.column("doc").to_pylist(), t.column("keys").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], raw[k]))
        return np.array([ids[k] for k in order], np.int64), [np.frombuffer(raw[k], np.uint64) for k in order]

    def keys_of(sets: list[np.ndarray]) -> KeySet:
        return key_set([s >> _HIGH for s in sets])

    def send_all(t: pa.Table) -> pa.Table:
        return keys_of(left_of(t)[1]).message(t.column("sender")[0].as_py())

    def common_of(t: pa.Table, answers: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, size, shared shingles) of the sets with enough of them."""
        ids, sets = left_of(t)
        shared = keys_of(sets).shared(answers)
        for i, s in zip(ids.tolist(), sets):
            common = s[member(s >> _HIGH, shared)]
            if len(common) >= needed(len(s), threshold):
                yield i, len(s), common

    def rare_of(t: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, ids, sizes): the shared ones among the first shingles of each set, where those met once come first. Keys ascend."""
        keys, ids, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, n, common in common_of(t, answers):
            first = distinct(common[: first_ones(n, threshold) - (n - len(common))] >> _HIGH)
            keys.append(first)
            ids.append(np.full(len(first), i))
            sizes.append(np.full(len(first), n))
        key, i, n = map(np.concatenate, (keys, ids, sizes))
        order = np.lexsort((i, key))
        return key[order], i[order], n[order]

    def rare_messages(key: np.ndarray, i: np.ndarray, several: np.ndarray, sender: int, buckets: int) -> pa.Table:
        """Ascending keys, each with its least id and whether several sets have it."""
        out = [(b, pack_sorted(key[part]), pack(i[part]), pack_bits(several[part])) for b, part in (bucket_slices(range_of(key, buckets)) if len(key) else ())]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "sender": pa.array([sender] * len(out), pa.int64()), **{c: pa.array([x[k] for x in out], pa.binary()) for k, c in ((1, "a"), (2, "b"), (3, "c"))}})

    def send_rare(t: pa.Table, answers: pa.Table) -> pa.Table:
        key, i, _ = rare_of(t, answers)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        return rare_messages(key[new], i[new], np.diff(new, append=len(key)) > 1, number_of(t, answers), buckets)

    def gathered(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Each sender's keys; of all, ascending: the distinct keys, their least ids, and whether several sets have them."""
        keys, ids = [unpack_sorted(x) for x in t.column("a").to_pylist()], [unpack(x, np.int64) for x in t.column("b").to_pylist()]
        several = np.concatenate([unpack_bits(x, len(k)) for x, k in zip(t.column("c").to_pylist(), keys)])
        key, i = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        met = (np.diff(cuts, append=len(key)) > 1) | np.logical_or.reduceat(several[order], cuts)
        return keys, key[order][cuts], np.minimum.reduceat(i[order], cuts), met

    def tell(t: pa.Table, keys: list[np.ndarray], known: np.ndarray, leader: np.ndarray) -> pa.Table:
        return pa.table({"receiver": t.column("sender"), "bucket": t.column("bucket"), "leaders": pa.array([pack(leader[np.searchsorted(known, k)]) for k in keys], pa.binary())})

    def choose_leaders(t: pa.Table) -> pa.Table:
        """To each sender its keys' leaders, the least ids that have them; none (the highest number) where one set only has the key."""
        keys, known, least, met = gathered(t)
        return tell(t, keys, known, np.where(met, least, NONE))

    def merge_rare(t: pa.Table, node: int) -> pa.Table:
        _, known, least, met = gathered(t)
        return rare_messages(known, least, met, node, dealing.coarse * dealing.fine)

    def split_leaders(t: pa.Table, told: pa.Table) -> pa.Table:
        keys, known, _, _ = gathered(t)
        return tell(t, keys, known, np.concatenate([unpack(x, np.int64) for x in told.column("leaders").to_pylist()]))

    def list_leaders(t: pa.Table, messages: pa.Table) -> pa.Table:
        """(leader, doc, receiver, size), each once, of a group's documents."""
        found = np.zeros((0, 3), np.int64)
        if t.num_rows:
            key, i, n = rare_of(t, messages.filter(pc.is_valid(messages.column("bits"))))
            of = np.cumsum(np.concatenate((np.zeros(min(len(key), 1), np.int64), (key[1:] != key[:-1]).astype(np.int64))))  # keys ascend
            told = messages.filter(pc.is_valid(messages.column("leaders"))).sort_by("bucket")  # buckets and keys ascend alike
            leader = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.int64) for x in told.column("leaders").to_pylist())])[of]
            found = np.stack((leader, i, n), 1)[leader != NONE]
            found = found[np.lexsort(found.T[::-1])]
            found = found[np.concatenate((np.ones(min(len(found), 1), bool), (found[1:] != found[:-1]).any(1)))]
        return pa.table({"leader": pa.array(found[:, 0]), "doc": pa.array(found[:, 1]), "receiver": pa.array([number_of(t, messages)] * len(found), pa.int64()), "size": pa.array(found[:, 2])})

    def send_sets(t: pa.Table, messages: pa.Table) -> pa.Table:
        """Each document's shared shingles, to each of its tasks."""
        asked = messages.filter(pc.is_valid(messages.column("leader")))
        where: dict[int, list[tuple[int, int, int]]] = {}
        for d, *task in zip(*(asked.column(c).to_pylist() for c in ("doc", "leader", "task", "tasks"))):
            where.setdefault(d, []).append(tuple(task))
        out = []
        if where:
            for i, n, common in common_of(t, messages.filter(pc.is_valid(messages.column("bits")))):
                raw = common.tobytes()
                out += [(*task, i, n, raw) for task in where.get(i, ())]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["leader", "task", "tasks", "doc", "size", "keys"])

    def search(t: pa.Table) -> pa.Table:
        found = search_of(t)
        found.all_links()
        ids, roots = found.ids, found.root
        leader, task, tasks = (t.column(c)[0].as_py() for c in ("leader", "task", "tasks"))
        u = np.flatnonzero(ids != ids[roots])
        rest = np.flatnonzero(~np.isin(roots, roots[ids == leader])) if tasks > 1 else np.zeros(0, np.int64)
        n, m = len(u), len(rest)
        return pa.table({
            "u": pa.array([*ids[u].tolist(), *[None] * m], pa.int64()), "v": pa.array([*ids[roots[u]].tolist(), *[None] * m], pa.int64()),
            "rest_id": pa.array([*[None] * n, *ids[rest].tolist()], pa.int64()), "rest_size": pa.array([*[None] * n, *found.sizes[rest].tolist()], pa.int64()), "rest_set": pa.array([*[None] * n, *(found.sets[k].tobytes() for k in rest)], pa.binary()),
            "leader": pa.array([leader] * (n + m), pa.int64()), "tasks": pa.array([tasks] * (n + m), pa.int64()),
        })

    def search_of(t: pa.Table) -> Search:
        ids, sizes, raw = (t.column(c).to_pylist() for c in ("doc", "size", "keys"))
        order = sorted(dict(zip(zip(ids, raw), range(len(ids)))).values(), key=lambda k: (ids[k], raw[k]))
        return Search(np.array([ids[k] for k in order], np.int64), np.array([sizes[k] for k in order], np.int64), [np.frombuffer(raw[k], np.uint64) for k in order], threshold)

    def search_rest(t: pa.Table, rest: pa.Table) -> pa.Table:
        u, v = [], []
        if t.num_rows and rest.num_rows:
            found = search_of(t)
            for i, n, raw in zip(*(rest.column(c).to_pylist() for c in ("rest_id", "rest_size", "rest_set"))):
                for d in found.search(np.frombuffer(raw, np.uint64), n, found.fits(n) & (found.ids != i)):
                    u.append(i)
                    v.append(int(found.ids[d]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    none = lambda kind: F.lit(None).cast(kind)
    grouped = rows.groupBy("grp")
    heads = exchange_keys(grouped.cogroup(skip.groupBy("receiver")).applyInArrow(send_heads, KEYS), dealing)
    messages = heads.select("*", none("binary").alias("skipped")).unionAll(skip.select("receiver", none("long"), none("binary"), "skipped"))
    left = stored(grouped.cogroup(messages.groupBy("receiver")).applyInArrow(keep_left, "sender long, doc long, keys binary"), "left").groupBy("sender")
    answers = exchange_keys(left.applyInArrow(send_all, KEYS), dealing)
    rare = left.cogroup(answers.groupBy("receiver")).applyInArrow(send_rare, KEYS + ", c binary")
    told = dealing.exchange(rare, KEYS + ", c binary", "receiver long, bucket long, leaders binary", choose_leaders, merge_rare, split_leaders)
    messages = answers.select("*", none("binary").alias("leaders")).unionAll(told.select("receiver", "bucket", none("binary"), "leaders"))
    led = stored(left.cogroup(messages.groupBy("receiver")).applyInArrow(list_leaders, "leader long, doc long, receiver long, size long"), "leaders")
    sizes = led.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("s")).filter("n > 1").select(F.col("leader").alias("of"), F.greatest(F.ceil(F.col("n") / task_docs), F.ceil(F.col("s") / task_shingles)).cast("long").alias("tasks"))
    every, one = F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1), F.array(F.pmod(F.xxhash64("doc"), F.col("tasks")))
    placed = led.join(sizes, F.col("leader") == F.col("of")).withColumn("task", F.explode(F.when(F.col("doc") == F.col("leader"), every).otherwise(one)))
    asked = placed.select("receiver", none("long").alias("bucket"), none("binary").alias("bits"), "leader", "task", "tasks", "doc")
    asked = answers.select("*", *[none("long").alias(c) for c in ("leader", "task", "tasks", "doc")]).unionAll(asked)
    sets = left.cogroup(asked.groupBy("receiver")).applyInArrow(send_sets, "leader long, task long, tasks long, doc long, size long, keys binary")
    links = stored(sets.groupBy("leader", "task").applyInArrow(search, "u long, v long, rest_id long, rest_size long, rest_set binary, leader long, tasks long"), "found")
    rest = links.filter("rest_id is not null")
    found = links.filter("u is not null").select("u", "v")
    if rest.isEmpty():
        return found
    queries = rest.withColumn("task", F.explode(every))
    return found.unionAll(sets.filter("tasks > 1").groupBy("leader", "task").cogroup(queries.groupBy("leader", "task")).applyInArrow(search_rest, "u long, v long"))


def set_digests(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, digest, grp) of every row of (doc_id, text, grp); the digest of an empty set is null."""

    def digests(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "digest", "grp"])

    return rows.mapInArrow(digests, "doc_id long, n_shingles long, digest binary, grp long")


def jaccard_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, group_bytes: int = GROUP_BYTES, fan: int = FAN, **limits: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    own = docs.select(quoted(ident).cast("long").alias("doc_id"), quoted(text).alias("text"))
    rows, total, groups = dealt(own, ["doc_id", "text"], "text", "grp", group_bytes)
    base = stored(set_digests(rows, words), "digests")
    classes = base.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("of_digest"), "least", "n")
    classed = stored(_with_class(base, stored(classes, "copies"), base.count() * HOT_SHARE), "classes")
    skip = classed.filter("doc_id > least").select(F.col("grp").alias("receiver"), F.concat(F.col("doc_id").cast("string").cast("binary"), F.lit(b"|"), "digest").alias("skipped"))
    links = find_links(rows, skip, Dealing(groups, max(8, total // max(group_bytes, total // groups)), fan), words, threshold, **limits)
    # An id with several sets connects their classes.
    known = classed.filter("digest is not null and doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min("least").alias("low"), F.max("least").alias("high")).filter("low < high").select(F.col("doc_id").alias("several_id"))
    own_links = known.join(several, F.col("doc_id") == F.col("several_id"), "left_semi").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    roots = components(links.unionAll(own_links))
    return classed.join(roots, F.col("least") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "least").alias("component_id"))


def _with_class(base: DataFrame, classes: DataFrame, hot: float) -> DataFrame:
    """(doc_id, n_shingles, digest, grp, least). Classes of very many documents are broadcast, so that their rows don't meet in one task."""
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("least")
    columns = ["doc_id", "n_shingles", "digest", "grp", least]
    same = F.col("digest") == F.col("of_digest")
    large = base.join(F.broadcast(classes.filter(F.col("n") >= hot)), same, "left")  # 1 / HOT_SHARE rows at most
    ready = F.col("least").isNotNull() | F.col("digest").isNull()
    rest = large.filter(~ready).select(*base.columns).join(classes.filter(F.col("n") < hot), same, "left")
    return large.filter(ready).select(*columns).unionAll(rest.select(*columns))


def keep_one_of_each(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows whose id is their component's; rows without words or id stay."""
    found = jaccard_components(docs, ident, text, words, threshold).filter("doc_id <> component_id")
    gone = fresh(docs.columns, "gone")[0]
    return docs.join(found.select(F.col("doc_id").alias(gone)).distinct(), quoted(ident) == quoted(gone), "left_anti")


def op7_divide_skip(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
