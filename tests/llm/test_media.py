import hashlib
import zipfile
import zlib

import numpy as np
import pytest

from gaugework.llm import files, media
from gaugework.session import work_dir

SCHEMA = "doc_id long, text string, media binary, feature int"


def brute(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    x = np.frombuffer(payload, np.uint8).astype(float)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), x.mean(), x.std()


def held(docs, rows):
    got = {}
    for r in media.media_table(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    same = {}
    for doc_id, text in rows:
        want = brute(text)
        assert any(tuple(r)[1:5] == want[:4] for r in got[doc_id])
        for r in got[doc_id]:
            assert same.setdefault(r.payload_sha256 + str(r.n_bytes), tuple(r)[1:]) == tuple(r)[1:]
            if tuple(r)[1:5] == want[:4]:
                mean, deviation = (float(x.split("=")[1]) for x in r.feature.split(";")[:2])
                assert abs(mean - want[4]) < 1e-3 and abs(deviation - want[5]) < 1e-3


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    held(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 63), (3, "a" * 64), (4, "b\0"), (4, "b\0"), (None, "é" * 100_000), (-7, "x")]
    held(spark.createDataFrame([(*r, b"m", 1) for r in rows], SCHEMA), rows)
    assert media.media_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranges_and_archives(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text").coalesce(2)
    folder = work_dir(spark, "media")
    assert media.write_archives(docs, folder, archive_bytes=4000) == 300
    assert len(files.listed(folder, ".zip")) > 5
    for size in (500, 1 << 20):
        df = media.read_archives(spark, folder, rangeBytes=size, batchBytes=300)
        assert sorted(r.doc_id for r in media.media_features(df).collect()) == list(range(300))


def test_a_member_is_read_again_by_itself(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k}_{k}.png", media.to_png(b"x" * k))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "attempts": "2"})
    opened, plain, checked = [], reader.open, media.ArchiveReader.checked

    def flaky(archive):
        opened.append(archive)
        if len(opened) == 2:  # the first is for the directory and all members
            raise OSError("gone")
        return plain(archive)

    def odd(data, info, base):
        if len(opened) == 1 and info.filename == "1_1.png":
            raise ValueError("damaged on its way")
        return checked(data, info, base)

    monkeypatch.setattr(reader, "open", flaky)
    (part,) = reader.partitions()
    read = lambda: [media.from_png(m)[1] for b in reader.read(part) for m in b.column(3).to_pylist()]
    assert read() == [0, 1, 2] and len(opened) == 1
    opened.clear()
    monkeypatch.setattr(reader, "checked", odd)
    assert read() == [0, 1, 2] and len(opened) == 3  # one member alone, whose first attempt fails
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[60] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(OSError, match="0_0.png at 0"):
        list(media.ArchiveReader({"path": f"file://{tmp_path}", "attempts": "2"}).read(part))
