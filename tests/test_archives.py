import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import archives

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "docs.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
            z.writestr(f"texts/{r.doc_id}.txt", r.text or "")
        z.writestr("texts/longer/notes.md", "x" * 9)
        z.mkdir("texts/empty")
    return path


def test_members_are_read_back(spark, archive):
    got = archives.archive_members(spark, [archive], suffix=".txt")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {(f"texts/{r.doc_id}.txt", len((r.text or "").encode()), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    assert {(r.member, r["size"], r.sha256) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == len(want)
    assert got.join(docs, F.col("member") == F.concat(F.lit("texts/"), "doc_id", F.lit(".txt"))).filter(F.col("content").cast("string") != F.col("text")).count() == 0


def test_directory_without_contents(spark, archive):
    rows = archives.archive_members(spark, [archive], content=False).collect()
    with zipfile.ZipFile(archive) as z:
        assert {(r.member, r["size"], r.packed, r.crc32) for r in rows} == {(i.filename, i.file_size, i.compress_size, i.CRC) for i in z.infolist() if not i.is_dir()}
    assert all(r.content is None and r.sha256 is None for r in rows)
    first = archives._ArchiveReader({"path": archive}).partitions()[0].names[0]
    assert len(first) == min(len(r.member) for r in rows)


def test_mirrors_in_order_and_damage(spark, archive, tmp_path):
    digest, other = archives.digest_of(archive), tmp_path / "other.zip"
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("a.txt", "abc" * 100)
    mirrors = [str(tmp_path / "none.zip"), str(other), archive]
    assert archives.archive_members(spark, mirrors, digest, ".md").first().member == "texts/longer/notes.md"
    assert archives.archive_members(spark, mirrors).first().member == "a.txt"
    with pytest.raises(Exception, match="another digest"):
        archives.archive_members(spark, mirrors[:2], digest).count()
    data = bytearray(other.read_bytes())
    data[40:44] = b"XXXX"
    other.write_bytes(data)
    with pytest.raises(Exception, match="CRC|Bad"):
        archives.archive_members(spark, [str(other)]).collect()
    with pytest.raises(Exception, match="mounted folder"):
        archives.archive_members(spark, ["s3://bucket/a.zip"]).count()


def test_rows_become_files(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(4).select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("file"), "text", F.lit(1).alias("name"))
    path = str(tmp_path / "out")
    manifest = archives.write_files(docs, "file", "text", path)
    want = sorted((r.file, len(r.text.encode()), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted(map(tuple, manifest.collect())) == want == sorted(map(tuple, archives.files_of(spark, path).collect()))
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(path)) == 5
    with pytest.raises(Exception, match="out"):
        archives.write_files(docs, "file", "text", path)
    assert sorted(os.listdir(tmp_path)) == ["out"]


@pytest.mark.parametrize("bad", ["../up.txt", ".hidden", "a/b", "", None])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"f{i}", "x") for i in range(40)] + [(bad, "y")], "name string, content string").repartition(5)
    with pytest.raises(Exception, match="not the name"):
        archives.write_files(rows, "name", "content", str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_names_twice_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("a", "x")], "name string, content string")
    with pytest.raises(ValueError, match="stands twice"):
        archives.write_files(rows, "name", "content", str(tmp_path / "out"))
    assert archives.write_files(rows.limit(1), "name", "content", str(tmp_path / "one")).first()["size"] in (0, 1)
    assert archives.write_files(rows.limit(0), "name", "content", str(tmp_path / "none")).count() == 0
