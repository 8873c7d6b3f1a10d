"""Operators 2 and 5 against brute force."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from planweft.llm import sharding, warc


def test_shards(spark, odd_documents, no_documents):
    rows = sharding.balanced_shards(odd_documents.repartition(5), shards=4).collect()
    wanted = sorted(((r.doc_id if r.doc_id is not None else -1), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_documents.collect())
    place, total = 0, sum(w[1] for w in wanted)
    slots: dict[int, int] = {}
    for r, w in zip(sorted(rows, key=lambda r: (r.shard, r.slot)), wanted, strict=True):
        assert ((r.doc_id if r.doc_id is not None else -1), r["size"], r.text_crc32) == w
        assert r.shard == min(3, (2 * place + w[1]) * 4 // (2 * total)) and r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        place += w[1]
    assert sharding.balanced_shards(no_documents).collect() == []


def test_shards_are_even(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id * 37 % 101 AS int)) AS text").repartition(7)
    sizes = [r["b"] for r in sharding.balanced_shards(docs, shards=24).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 109


@pytest.fixture
def pages(spark):
    long = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a", long), (2, "http://b", long), (5, "http://c", long), (3, None, "short"), (4, "http://d e\r\nf", "short"), (6, "http://g", None), (7, "http://h", ""), (8, "http://i", "x" * 3_000_000), (None, "http://j", long), (9, "u", "y" * 1000), (9, "u", "y" * 1000)]
    return spark.createDataFrame([(*r, "file", 0) for r in rows], "page_id long, url string, html string, file string, frame int").repartition(3)


def test_archives(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder, frame_bytes=4000, bundle_bytes=100_000)
    found = warc.read_archives(spark, folder, index).collect()
    given = {(r.page_id, (r.html or "").encode()) for r in pages.collect()}
    assert len(found) == 11
    for r in found:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload)) in given and hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
            assert r.refers_to is None
        else:
            assert r.refers_to == 5 and r.page_id in (1, 2, None) and r.payload is None and r.payload_bytes == 1607
    assert sum(r.record_type == "revisit" for r in found) == 3
    assert sum(r.page_id == 9 for r in found) == 2
    some = warc.read_records(spark, folder, index, spark.createDataFrame([(5,), (3,), (77,)], "page_id long")).collect()
    assert sorted(r.page_id for r in some) == [3, 5]
    assert index.where("record_id = '<urn:x-page:3>' AND offset >= 0").count() == 1


def test_frames_stand_alone(tmp_path):
    import zstandard

    fs, root = warc.file_system(f"file://{tmp_path}")
    bundle = warc.Bundle(fs.open_output_stream(f"{root}/x", compression=None), 1000, 3)
    rows = []
    for i in range(20):
        payload = bytes([65 + i]) * 300
        rows += bundle.add(warc.record_id(i), warc.to_record(i, "u", payload, hashlib.sha1(payload).hexdigest(), 300, None))
    rows += bundle.close()
    data = (tmp_path / "x").read_bytes()
    with fs.open_input_file(f"{root}/x") as source:
        frames = warc.seek_table(source, len(data))
    assert len(frames) > 3 and len(rows) == 20
    for identifier, frame, start, size, offset, length in rows:
        assert frames[frame][:2] == (start, size)
        (record,) = warc.from_frame(zstandard.ZstdDecompressor().decompress(data[start : start + size])[offset : offset + length])
        assert warc.record_id(record["page_id"]) == identifier
    damaged = warc.to_record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None)
    with pytest.raises(ValueError):
        list(warc.from_frame(damaged))


def test_no_pages(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == []
