"""Files by ranges of their bytes: archives, digests and numbered lines, also beyond 2 GB."""

import hashlib
import random
import tarfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from relata.sources import files

GB = 1 << 30


def add(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, BytesIO(data))


def archive(path, members, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        for name, data in members:
            add(tar, name, data)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """An archive of 2.2 GB, most of it one member that is a hole in the file."""
    path = tmp_path_factory.mktemp("large") / "set-1.tar"
    rng = random.Random(3)
    wanted = {f"1/{k:03d}/instances.json": rng.randbytes(200_000) for k in range(12)}
    early, late = list(wanted.items())[:6], list(wanted.items())[6:]
    with open(path, "wb") as f:
        part = BytesIO()
        with tarfile.open(fileobj=part, mode="w") as tar:
            for name, data in early:
                add(tar, name, data)
            f.write(part.getvalue()[: tar.offset])
        hole = tarfile.TarInfo("1/depth.bin")
        hole.size = 2 * GB + 200 * (1 << 20)
        f.write(hole.tobuf())
        f.seek(hole.size, 1)
        part = BytesIO()
        with tarfile.open(fileobj=part, mode="w") as tar:
            for name, data in late:
                add(tar, name, data)
        f.write(part.getvalue())
    return path, wanted


def test_an_archive_over_two_gigabytes_is_read_by_several_tasks(spark, large):
    path, wanted = large
    assert path.stat().st_size > 2 * GB
    found = files.archive_members(spark, str(path.parent), ("instances.json",), split=100_000).withColumn("task", F.spark_partition_id()).collect()
    assert {r["member"]: bytes(r["content"]) for r in found} == wanted and len({r["task"] for r in found}) > 2
    index = {r["member"]: (r["offset"], r["size"]) for r in files.archive_index(spark, str(path.parent)).collect()}
    assert len(index) == 13 and index["1/depth.bin"][1] > 2 * GB
    with pytest.raises(Exception, match="too large for a row"):
        files.archive_members(spark, str(path.parent), ("depth.bin",)).count()


def test_the_data_source_plans_from_headers(spark, large, tmp_path):
    path, wanted = large
    archive(tmp_path / "set-2.tar", [("2/instances.json", b"[]"), ("2/" + "n" * 150 + "/image.png", b"x"), ("2/ü/image.png", b"")])
    spark.dataSource.register(files.TarMembers)
    both = spark.read.format("tar_members").option("suffixes", "instances.json").option("split", "500000").load(f"{path.parent},{tmp_path}")
    assert both.rdd.getNumPartitions() == 6
    assert {r["member"]: bytes(r["content"]) for r in both.collect()} == wanted | {"2/instances.json": b"[]"}
    spark.sql(f"create or replace temporary view members using tar_members options (path '{tmp_path}')")
    assert spark.sql("select member, length(content) as n from members order by n").collect() == [("2/ü/image.png", 0), ("2/" + "n" * 150 + "/image.png", 1), ("2/instances.json", 2)]
    assert spark.read.format("tar_members").option("suffixes", "none").load(str(tmp_path)).count() == 0


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_equal_tarfile(spark, tmp_path, form):
    rng = random.Random(5)
    for a in range(3):
        archive(tmp_path / f"set {a}.tar", [(f"{a}/{k}/{n}", rng.randbytes(rng.randrange(3000))) for k in range(20) for n in ("instances.json", "image.png", "other")], form)
    (tmp_path / "note.txt").write_text("no archive")
    found = {(r["archive"].rsplit("/", 1)[1], r["member"]): bytes(r["content"]) for r in files.archive_members(spark, str(tmp_path), split=4000).collect()}
    expected = {}
    for a in range(3):
        with tarfile.open(tmp_path / f"set {a}.tar") as tar:
            expected |= {(f"set {a}.tar", m.name): tar.extractfile(m).read() for m in tar if m.name.endswith(("instances.json", "image.png"))}
    assert found == expected


def test_broken_archives_are_errors(spark, tmp_path):
    archive(tmp_path / "a.tar", [("x/instances.json", b"z" * 5000)])
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(data[:3000])
    with pytest.raises(Exception, match="ends within"):
        files.archive_members(spark, str(tmp_path)).count()
    (tmp_path / "empty").mkdir()
    archive(tmp_path / "empty/b.tar", [])
    assert files.archive_members(spark, str(tmp_path / "empty")).count() == 0


def test_digests_of_files_of_any_size(spark, tmp_path):
    rng = random.Random(9)
    expected = {}
    for k, size in enumerate([0, 1, 5_000_000, 4 << 20, 77]):
        data = rng.randbytes(size)
        (tmp_path / f"f{k} ä.bin").write_bytes(data)
        expected[f"f{k} ä.bin"] = (size, hashlib.sha256(data).hexdigest())
    with open(tmp_path / "hole.bin", "wb") as f:
        f.truncate(2 * GB + 12345)
    whole = hashlib.sha256()
    for _ in range(2 * GB >> 24):
        whole.update(bytes(1 << 24))
    whole.update(bytes(12345))
    expected["hole.bin"] = (2 * GB + 12345, whole.hexdigest())
    found = files.file_hashes(files.file_sizes(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1]: (r["size_bytes"], r["sha256"]) for r in found} == expected
    few = files.file_sizes(spark, str(tmp_path), pattern="f4*")
    assert files.file_hashes(few, "md5").first()["md5"] == hashlib.md5((tmp_path / "f4 ä.bin").read_bytes()).hexdigest()


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_numbered_lines_by_ranges(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(files, "MAX_TASKS", 6)
    rng = random.Random(split)
    texts = {"a.txt": "", "b.txt": "\n", "c.txt": "one", "d.txt": "one\r\n\n  two \n\n", "e.txt": "\n".join("zeile ä " * rng.randrange(4) for _ in range(40 if split > 2 else 8))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = sorted((r["path"].rsplit("/", 1)[1], r["line_number"], r["line"]) for r in files.numbered_lines(spark, str(tmp_path), split).collect())
    expected = []
    for name, text in texts.items():
        lines = text.split("\n")
        expected += [(name, k, line) for k, line in enumerate(lines[:-1] if not lines[-1] else lines, 1)]
    assert found == sorted(expected)


def test_short_ranges_share_tasks_and_read_little_behind_them(spark, tmp_path):
    class Counted:
        def __init__(self, f):
            self.f, self.n, self.seek = f, 0, f.seek

        def read(self, size):
            data = self.f.read(size)
            self.n += len(data)
            return data

    path = tmp_path / "a.txt"
    path.write_bytes(b"".join(b"%07d\n" % k for k in range(100_000)) + b"x" * 500_000 + b"\nlast")
    few = 4 * spark.sparkContext.defaultParallelism
    assert files.numbered_lines(spark, str(tmp_path), 1000).rdd.getNumPartitions() <= few
    archive(tmp_path / "a.tar", [(f"{k}/instances.json", bytes(100)) for k in range(500)])
    assert files.archive_members(spark, str(tmp_path), split=100).rdd.getNumPartitions() <= few
    with files.opened(str(path)) as f:
        read = Counted(f)
        assert list(files._lines_of(read, 8000, 8016)) == [b"0001000", b"0001001"] and read.n < 10_000
        read = Counted(f)
        assert list(files._lines_of(read, 900_000, 901_000)) == [] and read.n < 10_000  # inside one long line
        read = Counted(f)
        assert [len(x) for x in files._lines_of(read, 800_000, 800_001)] == [500_000] and read.n < 2_000_000
        assert list(files._lines_of(Counted(f), 1_300_001, 1_300_005)) == [b"last"]
