"""Files written by many tasks: each its pieces at their places."""

import io
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from orolith.sinks import files, meshes


def made(spark, k, parts):
    """Pieces of 1000 k bytes of a file and an archive, dealt without regard to their order."""
    n = spark.range(k).repartition(parts)
    text = F.substring(F.repeat(F.sha2(F.col("id").cast("string"), 512), 8), 1, 1000)
    piece = lambda file, entry, section: n.select(F.lit("a").alias("job_id"), F.lit(file).alias("file"), F.lit(entry).cast("string").alias("entry"), F.lit(section).alias("section"), F.col("id").alias("n"), F.concat(F.lit(f"{section}:"), text).cast("binary").alias("payload"))
    return piece("x.bin", None, 1).unionByName(piece("x.bin", None, 0)).unionByName(piece("x.zip", "b/é.txt", 0)).unionByName(piece("x.zip", "a.txt", 2))


def test_a_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task is handed more than the pieces of a few stored files."""
    pieces, seen = made(spark, 200, 3), tmp_path / "seen"
    seen.mkdir()
    real = type(pieces).mapInPandas

    def noting(self, func, *more, **named):
        def noted(frames):
            for frame in frames:
                if "payload" in frame.columns:
                    with open(seen / str(TaskContext.get().taskAttemptId()), "a") as f:
                        f.write(f"{sum(map(len, frame.payload))}\n")
                yield frame

        return real(self, lambda frames: func(noted(frames)), *more, **named)

    monkeypatch.setattr(type(pieces), "mapInPandas", noting)
    small = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "16384"}
    try:
        for k, x in small.items():
            spark.conf.set(k, x)
        got = {r.file: r.size for r in files.save(pieces, f"{tmp_path}/out").collect()}
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got == {f: os.path.getsize(tmp_path / "out/a" / f) for f in ("x.bin", "x.zip")}
    sums = [sum(map(int, f.read_text().split())) for f in seen.iterdir()]
    assert sum(sums) == 4 * 200 * 1002 and len(sums) >= 8 and max(sums) < sum(sums) / 4


def test_pieces_stand_in_order_and_archives_are_whole(spark, tmp_path):
    want = {}
    for r in sorted(made(spark, 50, 1).collect(), key=lambda r: (r.file, (r.entry or "").encode(), r.section, r.n)):
        want[(r.file, r.entry)] = want.get((r.file, r.entry), b"") + bytes(r.payload)
    files.save(made(spark, 50, 7), str(tmp_path))
    assert sorted(os.listdir(tmp_path / "a")) == ["x.bin", "x.zip"]
    assert (tmp_path / "a/x.bin").read_bytes() == want["x.bin", None]
    archive = zipfile.ZipFile(io.BytesIO((tmp_path / "a/x.zip").read_bytes()))
    assert archive.testzip() is None and archive.namelist() == ["a.txt", "b/é.txt"]
    assert all(archive.read(n) == want["x.zip", n] for n in archive.namelist())


def test_a_file_is_replaced_as_a_whole_and_empty_pieces_count(spark, tmp_path):
    row = lambda file, entry, n, data: ("a", file, entry, 0, n, data)
    save = lambda *rows: {r.file: r.size for r in files.save(spark.createDataFrame(rows, files.PIECE), str(tmp_path)).collect()}
    assert save(row("t", None, 0, b"long before")) == {"t": 11}
    assert save(row("t", None, 0, b""), row("t", None, 1, b"now"), row("e", None, 0, b""), row("z", "empty", 0, b""), row("z", "one", 0, b"1")).keys() == {"t", "e", "z"}
    assert (tmp_path / "a/t").read_bytes() == b"now" and (tmp_path / "a/e").read_bytes() == b""
    archive = zipfile.ZipFile(tmp_path / "a/z")
    assert {n: archive.read(n) for n in archive.namelist()} == {"empty": b"", "one": b"1"} and archive.testzip() is None
    assert files.save(spark.createDataFrame([], files.PIECE), str(tmp_path)).count() == 0


@pytest.mark.parametrize("sizes", [(0, 3), (5, 0), (1, 1), (70, 1 << 16), (4097, 12345)])
def test_checksums_of_parts_make_that_of_the_whole(sizes):
    a, b = (bytes((k * k + n) % 251 for k in range(n)) for n in sizes)
    assert files.crc_before(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_blocks_of_many_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    """With a count, tasks take about TASK_ROWS rows; the pieces are the same."""
    monkeypatch.setattr(meshes, "BLOCK", 16)
    monkeypatch.setattr(meshes, "TASK_ROWS", 64)
    rows = spark.range(1000).select(F.substring(F.concat(F.lit("a"), "id"), 1, 1).alias("job_id"), F.col("id").alias("n"), (F.col("id") / 7).alias("x"))
    pack = lambda count: meshes.packed(rows, "f", None, 0, [("x", "<f4")], count)
    few, many = pack(0), pack(1000)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert ", 16), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert b"".join(bytes(r.payload) for r in few.orderBy("n").collect()) == np.float32(np.arange(1000) / 7).tobytes()
