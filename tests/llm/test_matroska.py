import collections
import hashlib
import random
import struct
import zlib

import pytest

from lumenframe.llm import matroska as M


def test_round_trip_and_cues():
    for n in (64, 1024, 1088, 8192, 8256, 40_000 // 64 * 64, 300_032):
        payload = random.Random(n).randbytes(n)
        data = M.mux(payload)
        media = M.parse(data)
        assert b"".join(data[a : a + s] for _, _, a, s, *_ in media.packets) == payload
        assert len(media.cues) == media.clusters and all(data[at : at + 4] == M.write_id(M.CLUSTER) for _, _, at in media.cues)
        times = [p[1] for p in media.packets]
        assert times == sorted(times) and times[-1] == (len(times) - 1) * 128_000_000
        assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8 and media.duration == n / 8


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16_382, 16_383, 2_097_150, 2_097_151, 1 << 30])
def test_variable_length_sizes(n):
    raw = M.write_size(n)
    assert M.read_size(raw, 0, len(raw)) == (n, len(raw), len(raw))
    assert M.read_size(M.write_size(n, 8), 0, 8)[0] == n
    assert M.read_size(b"\xff", 0, 1)[0] == -1


def segment(*clusters, size=None):
    body = b"".join(clusters)
    head = M.element(M.EBML, M.element(M.EBML_DOCTYPE, b"matroska"))
    return head + M.write_id(M.SEGMENT) + (M.write_size(len(body)) if size is None else size) + body


def cluster(*blocks, time=5, size=None):
    body = M.unsigned(M.TIMESTAMP, time) + b"".join(blocks)
    return M.write_id(M.CLUSTER) + (M.write_size(len(body)) if size is None else size) + body


def test_all_lacings():
    frames = [b"a" * 300, b"b" * 255, b"c" * 10, b"d"]
    xiph = bytes([0x81]) + struct.pack(">h", -2) + bytes([M.XIPH_LACING << 1, 3]) + bytes([255, 45, 255, 0, 10]) + b"".join(frames)
    ebml = M.write_block(1, 0, frames)
    fixed = M.write_block(1, 0, [b"xy", b"zw"])
    single = M.write_block(1, 0, [b"q"])
    data = segment(cluster(*[M.element(M.SIMPLE_BLOCK, b) for b in (xiph, ebml, fixed, single)]))
    found = M.parse(data).packets
    assert [data[a : a + s] for _, _, a, s, *_ in found] == [*frames, *frames, b"xy", b"zw", b"q"]
    assert [p[6] for p in found] == [1] * 4 + [3] * 4 + [2] * 2 + [0] and found[0][1] == 3_000_000 and not found[0][4]


def test_unknown_sizes_and_block_groups():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.write_block(2, 1, [b"ab", b"cd"])) + M.unsigned(M.BLOCK_DURATION, 10))
    simple = M.element(M.SIMPLE_BLOCK, M.write_block(1, 0, [b"zz"]))
    data = segment(cluster(group, size=b"\xff"), cluster(simple, time=70, size=b"\x01" + b"\xff" * 7), size=b"\x01" + b"\xff" * 7)
    media = M.parse(data)
    assert media.clusters == 2 and [(p[0], p[1]) for p in media.packets] == [(2, 6_000_000), (2, 11_000_000), (1, 70_000_000)]


def test_broken_files(spark):
    good = M.mux(b"x" * 2048)
    for data in (b"", b"\x00", good[:40], good[:-10], b"RIFF" + good, good[:60] + b"\x00" * 20 + good[80:]):
        with pytest.raises(ValueError):
            M.parse(data)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    rows = M.packet_table(df, "id", "media").collect()
    assert [r["size"] for r in rows if r["media_id"] == 1] == [1024, 1024] and [r["error"] is not None for r in rows if r["media_id"] == 2] == [True] and not [r for r in rows if r["media_id"] == 3]


def test_contract(spark, clashing, no_documents, tmp_path):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    rows = M.op9_matroska(spark, str(tmp_path)).collect()
    assert len(rows) == clashing.count()
    texts = {}
    for r in clashing.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    by_payload = {}
    for r in rows:
        found = False
        for t in texts[r["doc_id"]]:
            n, payload = M.padded(t)
            stored = M.mux(payload)
            found |= (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
            assert len(payload) % 64 == 0 and len(payload) >= 64
        assert found and by_payload.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    no_documents.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert M.op9_matroska(spark, str(tmp_path / "none")).count() == 0


def plain_frames(data):
    """The samples of a file, by a reader of its own that knows known sizes, simple blocks, no lacing and EBML lacing."""

    def vint(at, keep):
        first = data[at]
        n = 8 - first.bit_length() + 1
        x = int.from_bytes(data[at : at + n], "big")
        return (x if keep else x - (1 << 7 * n)), at + n

    def walk(at, end):
        while at < end:
            ident, at = vint(at, True)
            size, at = vint(at, False)
            yield ident, at, at + size
            at += size

    def signed(at):
        x, after = vint(at, False)
        return x - (1 << (7 * (after - at) - 1)) + 1, after

    out, counts = [], {"clusters": 0, "cues": 0, "packets": 0, "last": 0}
    (_, a, b) = next(e for e in walk(0, len(data)) if e[0] == 0x18538067)
    for ident, x, y in walk(a, b):
        if ident == 0x1C53BB6B:
            counts["cues"] += sum(i == 0xBB for i, _, _ in walk(x, y))
        if ident != 0x1F43B675:
            continue
        counts["clusters"] += 1
        time = 0
        for i, p, q in walk(x, y):
            if i == 0xE7:
                time = int.from_bytes(data[p:q], "big")
            elif i == 0xA3:
                _, p = vint(p, False)
                start, flags = time + int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
                p += 3
                sizes = []
                if flags >> 1 & 3:
                    n, p = data[p] + 1, p + 1
                    if flags >> 1 & 3 == 2:
                        sizes = [(q - p) // n] * n
                    else:
                        assert flags >> 1 & 3 == 3
                        size, p = vint(p, False)
                        sizes = [size]
                        for _ in range(n - 2):
                            step, p = signed(p)
                            sizes.append(sizes[-1] + step)
                        sizes.append(q - p - sum(sizes))
                else:
                    sizes = [q - p]
                for k, size in enumerate(sizes):
                    out.append(data[p : p + size])
                    p += size
                    counts["last"] = start + 128 * k
                counts["packets"] += len(sizes)
    return b"".join(out), counts


def test_stored_files_and_features_are_those_of_a_plain_reader(spark, nasty):
    rows = M.mux_texts(nasty, "doc_id", "text").collect()
    digests = collections.defaultdict(list)
    for r in M.media_digests(M.mux_texts(nasty, "doc_id", "text")).collect():
        digests[r["media_sha256"]].append(r)
    assert len(rows) == nasty.count()
    for r in rows:
        samples, counts = plain_frames(bytes(r["media"]))
        for d in digests[hashlib.sha256(r["media"]).hexdigest()]:
            assert samples[: r["n_bytes"]].decode() in {x["text"] or "" for x in nasty.collect()} and len(samples) % 64 == 0 and not any(samples[r["n_bytes"] :])
            assert (d["payload_sha256"], d["tail_crc32"], d["payload_bytes"]) == (hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(samples))
            crossings = sum((a < 128) != (b < 128) for a, b in zip(samples, samples[1:]))
            assert d["feature"] == f"clusters={counts['clusters']};cues={counts['cues']};packets={counts['packets']};last_ms={counts['last']};sum={sum(samples)};energy={sum((x - 128) ** 2 for x in samples)};crossings={crossings}"
