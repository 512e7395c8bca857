import hashlib
import tarfile
import zlib

import pytest
from data import clashing, corpus, frame, row

from labelq.llm import media as M


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 576, b"y" * 577, bytes(range(256)) * 9])
def test_lossless(data):
    payload = M.pad(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload[:len(data)] == data and set(payload[len(data):]) <= {255}
    stored = M.encode(payload)
    assert M.decode(stored) == payload and M.header(stored[:M.HEADER]) == (576, len(payload) // 576, 8)
    at = 8
    while at < len(stored):  # chunk checksums
        n = int.from_bytes(stored[at:at + 4], "big")
        assert zlib.crc32(stored[at + 4:at + 8 + n]) == int.from_bytes(stored[at + 8 + n:at + 12 + n], "big")
        at += 12 + n


def test_round_trip_through_shards(spark):
    rows = corpus(n=20) + [row(800 + k, "the same text in many rows") for k in range(7)] + [row(801, "the same text in many rows"), row(None, "no id"), row(None, None)]
    docs, index, folder = M.media_columns(clashing(frame(spark, rows)))
    texts = {r[1] or "" for r in rows}
    ix = index.collect()
    assert sorted(r.digest for r in ix) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    files, base = M._filesystem(folder)
    stored = {}
    for name in {r.shard for r in ix}:
        with tarfile.open(f"{base}/{name}") as t:
            for m in t.getmembers():
                assert m.name not in stored
                stored[m.name] = (name, m.offset_data, m.size)
    assert {f"{r.digest}.png": (r.shard, r.offset, r.length) for r in ix} == stored
    assert all((r.width, r.bits) == (576, 8) for r in ix)
    found = {r.digest: r for r in M.read_payloads(index, folder).collect()}
    for t in texts:
        p, f = M.pad(t.encode()), found[hashlib.sha256(t.encode()).hexdigest()]
        assert (f.payload_bytes, f.payload_sha256, f.tail_crc32, f.media_sha256) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(M.encode(p)).hexdigest())
        assert f.feature == M.feature(p) and f.media_bytes == len(M.encode(p))
    assert docs.count() == len(rows)


def test_query(spark, tmp_path):
    rows = [row(1, "é"), row(2, None), row(3, "é")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    r = {x.doc_id: x for x in M.op9_media_columns(spark, str(tmp_path)).collect()}
    assert r[1].n_bytes == 2 and r[2].n_bytes == 0 and r[1].asDict() | {"doc_id": 3} == r[3].asDict()
    assert r[2].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest()


def test_empty(spark):
    docs, index, _ = M.media_columns(frame(spark, []))
    assert docs.count() == 0 and index.count() == 0


def test_bad_bytes_are_refused():
    with pytest.raises(ValueError):
        M.header(b"x" * 33)
