"""Token ids in binary files of compressed planes, with a chunk index.

File format (all numbers little-endian):

* ``TPLN``, one byte for the unit (1 byte planes, 2 bit planes), then blocks of
  at most ``BLOCK`` 32-bit ids. A block is transposed into planes (the first
  bytes, or bits, of all ids, then the second ones, ...), and each plane is
  compressed by zstandard: equal high planes shrink to nothing.
* the index, compressed: for every block its place, its number of ids and the
  sizes of its planes; for every document its id and its number of ids;
* the length of the index (8 bytes) and ``TPLN``.

Writing: documents go to ranges of ascending ``doc_id``; each task encodes and
writes its ranges block by block, so that memory holds one block and one
document. A file is written under a temporary name and moved when complete, so
a task that runs again gives the same file. Reading goes block by block.

Defined cases: null text has no ids but the end id; a null doc_id sorts first
and is returned as null; documents of equal doc_id are written one after the
other; an empty table gives no files and no rows; other columns are ignored."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, stored
from .tokens import packed_tokenizer

MAGIC, BLOCK, LEVEL = b"TPLN", 1 << 16, 3
#: Documents of a range, most ranges, and ids of a file before a new one starts.
DOCS, RANGES, FILE_IDS = 8192, 4096, 1 << 26
_NO_ID = -(1 << 63)
_UNITS = {"byte": 1, "bit": 2}


def to_planes(ids: np.ndarray, unit: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == 1:
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, unit: int) -> np.ndarray:
    if unit == 1:
        return np.column_stack([np.frombuffer(p, np.uint8) for p in planes]).reshape(-1).view("<u4")
    bits = np.column_stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes documents' ids (packed 32-bit) to an output stream."""

    def __init__(self, out, unit: str = "byte", block: int = BLOCK):
        import zstandard

        self.out, self.unit, self.block = out, _UNITS[unit], block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.rest, self.docs, self.blocks, self.n = bytearray(), [], [], 0
        self.at = self.out.write(MAGIC + bytes([self.unit])) or 5

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((_NO_ID if doc is None else doc, len(ids) // 4))
        self.n += len(ids) // 4
        self.rest += ids
        size = 4 * self.block
        while len(self.rest) >= size:
            self._flush(bytes(self.rest[:size]))
            del self.rest[:size]

    def _flush(self, ids: bytes) -> None:
        planes = [self.pack(p) for p in to_planes(np.frombuffer(ids, "<u4"), self.unit)]
        self.blocks.append((self.at, len(ids) // 4, *map(len, planes)))
        for p in planes:
            self.out.write(p)
        self.at += sum(map(len, planes))

    def finish(self) -> None:
        if self.rest:
            self._flush(bytes(self.rest))
        index = self.pack(struct.pack("<QQ", len(self.blocks), len(self.docs)) + np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class PlaneReader:
    """Reads a file of planes from a seekable input."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        head, tail = self._read(0, 5), self._read(size - 12, 12)
        if head[:4] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a complete file of token planes")
        self.unit, n = head[4], struct.unpack("<Q", tail[:8])[0]
        raw = self.unpack(self._read(size - 12 - n, n))
        blocks, docs = struct.unpack_from("<QQ", raw)
        width = 2 + (4 if self.unit == 1 else 32)
        self.blocks = np.frombuffer(raw, "<i8", blocks * width, 16).reshape(-1, width)
        self.docs = np.frombuffer(raw, "<i8", docs * 2, 16 + 8 * blocks * width).reshape(-1, 2)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block_ids(self, k: int) -> np.ndarray:
        at, n, *sizes = self.blocks[k].tolist()
        raw, ends = self._read(at, sum(sizes)), np.cumsum([0, *sizes])
        return from_planes([self.unpack(raw[a:b]) for a, b in zip(ends, ends[1:])], n, self.unit)

    def pieces(self):
        """(document number, packed ids) in order; a document may come in
        several pieces, one for each block that it lies in."""
        doc, left = 0, int(self.docs[0, 1]) if len(self.docs) else 0
        for k in range(len(self.blocks)):
            ids, at = self.block_ids(k).tobytes(), 0
            while at < len(ids):
                while not left:
                    doc += 1
                    left = int(self.docs[doc, 1])
                take = min(4 * left, len(ids) - at)
                yield doc, ids[at:at + take]
                at, left = at + take, left - take // 4


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it lies in the cluster's default
    file system, which need not be the executor's disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _range_of(doc: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``doc``: bisection."""
    def search(b):
        def step(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            right = (acc["lo"] < acc["hi"]) & (F.get(b, mid) <= doc)
            return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                            F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda acc: acc["lo"])

    return let(F.array(*[F.lit(x).cast("long") for x in bounds]), search) if bounds else F.lit(0)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, unit: str = "byte") -> DataFrame:
    """Encode and write all documents under ``path``. The result is the stored
    manifest: file, range, part, n_docs, n_ids, start (ids in files before)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path, n = qualified(docs.sparkSession, path), docs.agg(F.count("*")).first()[0]
    ranges = max(1, min(RANGES, -(-n // DOCS)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    rows = docs.withColumn("range", F.coalesce(_range_of(F.col("doc_id"), sorted(set(cuts or []))), F.lit(0)).cast("long"))

    def run(batches):
        import uuid

        import pyarrow as pa

        encode, end = packed_tokenizer(tokenizer).encode, int(end_id).to_bytes(4, "little")
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        now, writer = None, None

        def close():
            writer.finish()
            writer.out.close()
            fs.move(temp, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"file": name, "range": now[0], "part": now[1], "n_docs": len(writer.docs), "n_ids": writer.n}], schema)

        for batch in batches:
            for rng, doc, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1)):
                if now is None or rng != now[0] or writer.n >= FILE_IDS:
                    if now is not None:
                        yield close()
                    now = (rng, now[1] + 1 if now and now[0] == rng else 0)
                    name = f"ids-{now[0]:05d}-{now[1]:05d}.tpl"
                    temp = f"{base}/.{name}.{uuid.uuid4().hex}"
                    writer = PlaneWriter(fs.open_output_stream(temp), unit)
                writer.add(doc, encode(text.as_py() or "") + end)
        if now is not None:
            yield close()

    made = (rows.repartition("range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"))
            .mapInArrow(run, "file string, range long, part long, n_docs long, n_ids long"))
    # one row for each file, some thousands at most
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(stored(made, "files").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    path = qualified(manifest.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        fs, base = _open(path)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{file}") as source:
                    reader = PlaneReader(source, source.size())
                    crc = np.zeros(len(reader.docs), np.int64)
                    for doc, ids in reader.pieces():
                        crc[doc] = zlib.crc32(ids, int(crc[doc]))
                ids, n = reader.docs[:, 0], reader.docs[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(first + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one task a file: the manifest is tiny, so its own exchange would end as one
    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
