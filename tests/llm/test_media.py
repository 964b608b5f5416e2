import hashlib
import os
import zlib

import pytest

from relgrid.llm import media, queries


def test_png_round_trip():
    for payload in (b"\0" * 64, bytes(range(256)), os.urandom(64 * 100)):
        assert media.decode_png(media.encode_png(payload)) == payload
    broken = bytearray(media.encode_png(b"a" * 64))
    broken[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(broken))


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_media(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    seen = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.error) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), None)
        assert seen.setdefault(raw, r.feature) == r.feature


def test_members_fail_by_themselves(spark, docs, tmp_path):
    rows = docs([(k, f"text {k} " * 50, None) for k in range(40)]).coalesce(1)
    media.store(rows, str(tmp_path / "a"))
    archive = next((tmp_path / "a").glob("*.zip"))
    member = media.load(spark, str(tmp_path / "a")).orderBy("member_offset").collect()[7]
    data = bytearray(archive.read_bytes())
    data[member.member_offset + 30 + len(member.name) + 40] ^= 255
    archive.write_bytes(bytes(data))
    found = media.load(spark, str(tmp_path / "a")).collect()
    assert len(found) == 40 and [r.name for r in found if r.error] == [member.name]
    assert sum(r.media is not None for r in found) == 39
    described = {r.doc_id: r for r in media.describe(media.load(spark, str(tmp_path / "a"))).collect()}
    assert len(described) == 40 and sum(r.error is not None for r in described.values()) == 1


def test_short_and_lost_archives(spark, docs, tmp_path):
    """What is cut off in the middle of a header is an error of its members only; an archive without a directory stops the job."""
    system = media.pafs.LocalFileSystem()
    path = str(tmp_path / "short")
    (tmp_path / "short").write_bytes(b"PK\x03\x04 short")
    reader = media.ArchiveReader(str(tmp_path), dict(media.DEFAULTS, attempts=2))
    for offset in (0, 5, 500):
        got, error = reader.fetch(system, path, offset, 10, 0, 2)
        assert got is None and error
    with pytest.raises(OSError, match="short"):
        reader.directory(system, media.ByteRange(path, 0, 100), 2)


def test_ids_of_any_type(spark, tmp_path):
    rows = spark.createDataFrame([("null", "a", 1), ("x/9 é", "b", 2), (None, "c", 3), ("", None, 4)], "doc_id string, text string, name int")
    found = {r.doc_id: (r.n_bytes, r.error) for r in media.stored_features(rows).collect()}
    assert found == {"null": (1, None), "x/9 é": (1, None), None: (1, None), "": (0, None)}


def test_byte_ranges(spark, docs, tmp_path):
    rows = docs([(k, f"{k} " * 200, None) for k in range(300)])
    media.store(rows, str(tmp_path / "a"))
    reader = spark.read.format("media_archive").option("split_bytes", 4000).option("batch_bytes", 2000)
    found = reader.load(str(tmp_path / "a"))
    assert found.rdd.getNumPartitions() > 10
    assert len({r.name for r in found.collect()}) == found.count() == 300


def test_what_an_attempt_left_is_not_read(spark, docs, tmp_path):
    media.store(docs([(1, "x", None)]), str(tmp_path / "a"))
    (tmp_path / "a" / "left.zip").write_bytes(b"half an archive")
    assert media.load(spark, str(tmp_path / "a")).count() == 1


def test_odd_rows(spark, odd, none, tmp_path):
    rows = media.stored_features(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and by[1].payload_sha256 == by[2].payload_sha256 == hashlib.sha256(b"\0" * 64).hexdigest() and by[None].n_bytes == 10
    assert media.stored_features(none).count() == 0
