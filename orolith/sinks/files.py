"""Files written by tasks: a job's file is written by many of them, each its pieces at their places.

A piece is a row (job_id, file, entry, section, n, payload). A file's pieces stand in the order of entry,
section and n; with entry names the file is a ZIP archive, and each piece is packed by itself, as blocks of its
entry's stream. Pieces are stored once by the tasks that make them. Sums over their packed sizes give each its place, and a task writes what pieces it reads, with the memory of
a few, under another name first. When all are written, a task adds an archive's headers, made of numbers
alone, and renames the file; so a task that is run again leaves the same file. The folder must be shared
by all executors, and its file system must take writes at any place.
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orolith.storage import removed, sized, stored, table_path

PIECE = "job_id string, file string, entry string, section int, n long, payload binary"
#: Pieces in a stored file at most, so that a reader holds some tens of MB and what one task made is read by several.
STORED_PIECES = 16
#: Places of so many pieces may be broadcast, if their bytes allow it too.
PLACES = 1 << 19
#: Bytes of an archive entry's header beside its name, and those that end its packed stream.
ENTRY_HEAD, TAIL = 50, b"\x03\x00"


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


class Png:
    """The parts of a PNG from scan lines; the first piece is width and height."""

    def __init__(self):
        self.packer, self.begun = zlib.compressobj(6), False

    def add(self, data: bytes) -> bytes:
        if not self.begun:
            self.begun = True
            return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", data + bytes([8, 6, 0, 0, 0]))
        out = self.packer.compress(b"\0" + data)
        return png_chunk(b"IDAT", out) if out else b""

    def end(self) -> bytes:
        return png_chunk(b"IDAT", self.packer.flush()) + png_chunk(b"IEND", b"")


def crc_product(a: int, b: int) -> int:
    """Product of polynomials modulo that of CRC-32; the highest bit is the lowest power."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


#: x^(2^k).
CRC_POWERS = [1 << 30]
for _ in range(31):
    CRC_POWERS.append(crc_product(CRC_POWERS[-1], CRC_POWERS[-1]))


def crc_before(crc: int, after: int) -> int:
    """What bytes of this CRC-32 add (by xor) to that of a text in which `after` more bytes follow them."""
    k = 3
    while after:
        if after & 1:
            crc = crc_product(CRC_POWERS[k % 32], crc)
        after, k = after >> 1, k + 1
    return crc


def deflated(data: bytes) -> bytes:
    """data as whole blocks of a packed stream, which refer to nothing before them; more blocks may follow."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_SYNC_FLUSH)


def measured(batches):
    """Pieces with their packed size in place of their payload."""
    for b in batches:
        sizes = [len(p.as_py()) if e.as_py() is None else len(deflated(p.as_py())) for e, p in zip(b.column("entry"), b.column("payload"), strict=True)]
        yield b.drop_columns(["payload"]).append_column("size", pa.array(sizes, pa.int64()))


def places(sizes: DataFrame) -> DataFrame:
    """(piece, start, size, after): where in its file each piece (job_id, file, entry, section, n, piece, raw, size) begins, its
    size there, and how many bytes of its entry follow it once unpacked. A file's pieces are ordered here by their numbers; they hold
    thousands of rows each."""
    order = Window.partitionBy("job_id", "file").orderBy("entry", "section", "n", "piece")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("entry").over(order)
    opens = F.col("entry").isNotNull() & ~before.eqNullSafe(F.col("entry"))
    head = F.when(opens, F.octet_length("entry") + ENTRY_HEAD + F.when(before.isNotNull(), len(TAIL)).otherwise(0)).otherwise(0)
    ends = sizes.withColumn("head", head).withColumns({"end": F.sum(F.col("size") + F.col("head")).over(sofar), "read": F.sum("raw").over(sofar)})
    last = F.max("read").over(Window.partitionBy("job_id", "file", "entry"))
    return ends.select("piece", (F.col("end") - F.col("size")).alias("start"), "size", (last - F.col("read")).alias("after"))


def finished(part: str, path: str, entries: list) -> int:
    """Add headers and ends of entries to a file whose pieces are written, and give it its name; its size."""
    if entries[0]["entry"] is not None:
        infos = []
        with open(part, "r+b") as out:
            for e in sorted(entries, key=lambda e: e["start"]):
                info = zipfile.ZipInfo(e["entry"], (1980, 1, 1, 0, 0, 0))
                info.header_offset = e["start"] - len(e["entry"].encode()) - ENTRY_HEAD
                info.CRC, info.file_size, info.compress_size, info.external_attr = e["crc"], e["raw"], e["size"] + len(TAIL), 0o600 << 16
                info.compress_type = zipfile.ZIP_DEFLATED
                out.seek(info.header_offset)
                out.write(info.FileHeader(zip64=True))
                out.seek(e["start"] + e["size"])
                out.write(TAIL)
                infos.append(info)
            out.seek(0, os.SEEK_END)
            with zipfile.ZipFile(out, "w") as archive:
                archive.filelist.extend(infos)
    os.replace(part, path)
    return os.path.getsize(path)


def save(pieces: DataFrame, folder: str) -> DataFrame:
    """(job_id, file, size) of the files written under folder/job_id; they are there when this returns."""
    spark, suffix = pieces.sparkSession, f"{uuid.uuid4().hex}.part"

    def write(frames):
        now, out = None, None
        try:
            for frame in frames:
                crcs = []
                for p in frame.itertuples(index=False):
                    if (p.job_id, p.file) != now:
                        if out is not None:
                            os.close(out)
                            out = None
                        os.makedirs(f"{folder}/{p.job_id}", exist_ok=True)
                        out, now = os.open(f"{folder}/{p.job_id}/{p.file}.{suffix}", os.O_WRONLY | os.O_CREAT, 0o666), (p.job_id, p.file)
                    data, at = memoryview(p.payload if p.entry is None else deflated(p.payload)), p.start
                    if len(data) != p.size:
                        raise ValueError(f"a piece of {p.file} has {len(data)} bytes packed, and had {p.size}")
                    while data:
                        done = os.pwrite(out, data, at)
                        data, at = data[done:], at + done
                    crcs.append(0 if p.entry is None else crc_before(zlib.crc32(p.payload), p.after))
                yield frame[["job_id", "file", "entry", "start", "size", "raw"]].assign(crc=crcs)
        finally:
            if out is not None:
                os.close(out)

    def finish(frames):
        for frame in frames:
            sizes = [finished(f"{folder}/{r.job_id}/{r.file}.{suffix}", f"{folder}/{r.job_id}/{r.file}", list(r.entries)) for r in frame.itertuples(index=False)]
            yield frame[["job_id", "file"]].assign(size=sizes)

    numbered = pieces.withColumns({"piece": F.monotonically_increasing_id(), "raw": F.octet_length("payload").cast("long")})
    path = table_path(spark, "pieces")
    try:
        kept = stored(numbered, "pieces", path, STORED_PIECES)
        sizes = stored(kept.mapInArrow(measured, "job_id string, file string, entry string, section int, n long, piece long, raw long, size long"), "sizes")
        written = kept.join(sized(places(sizes), PLACES), "piece").select("job_id", "file", "entry", "start", "after", "size", "raw", "payload")
        written = written.mapInPandas(write, "job_id string, file string, entry string, start long, size long, raw long, crc long")
        entries = written.groupBy("job_id", "file", "entry").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("raw").alias("raw"), F.bit_xor("crc").alias("crc"))
        whole = entries.groupBy("job_id", "file").agg(F.collect_list(F.struct("entry", "start", "size", "raw", "crc")).alias("entries"))
        return stored(whole.mapInPandas(finish, "job_id string, file string, size long"), "written")
    finally:
        removed(spark, path)


def text_pieces(lines: DataFrame, file: str, entry: str | None, section: int, block: int = 4096) -> DataFrame:
    """Lines (job_id, n, line) as pieces of a text, `block` numbers together."""
    groups = lines.groupBy("job_id", F.floor(F.col("n") / block).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = F.concat(F.concat_ws("\n", F.transform("l", lambda x: x["line"])), F.lit("\n"))
    return groups.select("job_id", F.lit(file).alias("file"), F.lit(entry).cast("string").alias("entry"), F.lit(section).alias("section"), F.col("n").cast("long").alias("n"), text.cast("binary").alias("payload"))


def image_pieces(cells: DataFrame, file: str, entry: str | None = None) -> DataFrame:
    """RGBA cells (job_id, i, j, r, g, b, a) of full rasters as a PNG's pieces. A PNG is one packed stream, so an
    image's scan lines go through one task, line by line; a raster has at most 2048 x 2048 cells (16 MB)."""
    hexes = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    pixel = F.concat(*[hexes(c) for c in "rgba"])
    rows = cells.groupBy("job_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", pixel.alias("p")))).alias("l"))
    line = F.unhex(F.concat_ws("", F.transform("l", lambda x: x["p"])))
    size = cells.groupBy("job_id").agg((F.max("j") + 1).alias("w"), (F.max("i") + 1).alias("h"))
    head = F.unhex(F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 8, "0") for c in "wh"]))
    first = size.select("job_id", F.lit(-1).cast("long").alias("n"), head.alias("data"))
    lines = first.unionByName(rows.select("job_id", F.col("i").cast("long").alias("n"), line.alias("data")))

    def pack(frames):
        job, png = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if png is None or r.job_id != job:
                    if png is not None:
                        out.append((job, 1, 0, png.end()))
                    job, png = r.job_id, Png()
                if data := png.add(r.data):
                    out.append((job, 0, r.n, data))
            yield pieces(out)
        if png is not None:
            yield pieces([(job, 1, 0, png.end())])

    def pieces(rows):
        return pd.DataFrame([(job, file, entry, section, n, data) for job, section, n, data in rows], columns=["job_id", "file", "entry", "section", "n", "payload"])

    return lines.repartition("job_id").sortWithinPartitions("job_id", "n").mapInPandas(pack, PIECE)
