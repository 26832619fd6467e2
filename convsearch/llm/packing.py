"""Best-fit packing of token pieces into fixed-size sequences.

Method: exact-complement hashing on the histogram of lengths. For the longest
remaining length the gap of its sequence is looked up among the available
single lengths, pair sums and triple sums; a combination that fills the gap
exactly is consumed as often as the availability counts allow. Where no
combination fits, the longest length that still fits goes in (best fit) and
the smaller gap is looked up again.

The plan works on at most ``capacity`` distinct lengths however many pieces
there are, and every step uses up at least one length, so the driver holds a
few thousand patterns at most. The pieces themselves never leave the
executors: each is ranked within its length and finds its place by a binary
search among the segments of the plan.

Defined cases: null text is empty; a document without ids besides the end id
is one piece of length 1; an empty table gives no rows; repeated documents are
packed one by one; lengths of 0 or null take no part in ``pack``."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .tokens import packed_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length are numbered in blocks of about so many.
BLOCK = 250_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document (its ids,
    then ``end_id``): doc_id, piece, start, length, ids_crc32."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def run(batches):
        import pyarrow as pa

        encode, end, step = packed_tokenizer(tokenizer).encode, int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class _Lengths:
    """Availability counts of the lengths, with their pair sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        self.capacity, self.width = capacity, 1 << int(2 * capacity + 2).bit_length()
        self.index()

    def index(self) -> None:
        """Lengths in stock and the sums that two of them make."""
        self.have = self.n > 0
        f = np.fft.rfft(self.have.astype(np.float64), self.width)
        self.pairs = np.fft.irfft(f * f, self.width)[:self.capacity + 1] > 0.5

    def left(self, used: Counter) -> np.ndarray:
        n = self.n.copy()
        for length, count in used.items():
            n[length] -= count
        return n

    @staticmethod
    def pair(n: np.ndarray, gap: int) -> tuple[int, ...] | None:
        """The two lengths in stock that sum to ``gap``, the larger the better."""
        if gap < 2:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (n[a] > 0) & (n[gap - a] > 0)
        ok &= (2 * a != gap) | (n[a] > 1)
        k = int(np.argmax(ok)) if len(ok) else 0
        return (int(a[k]), int(gap - a[k])) if len(ok) and ok[k] else None

    def filling(self, used: Counter, gap: int) -> tuple[int, ...] | None:
        """A single length, pair or triple in stock that fills ``gap`` exactly."""
        n = self.left(used)
        if n[gap] > 0:
            return (gap,)
        if self.pairs[gap] and (two := self.pair(n, gap)):
            return two
        a = np.arange(gap - 2, 0, -1)
        for x in a[(n[a] > 0) & self.pairs[gap - a]].tolist():
            n[x] -= 1
            two = self.pair(n, gap - x)
            n[x] += 1
            if two:
                return (x, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: how many of it}) for each pattern of sequence."""
    stock, patterns = _Lengths(counts, capacity), []
    for first in range(capacity, 0, -1):
        while stock.n[first] > 0:
            used, gap = Counter([first]), capacity - first
            while gap:
                if exact := stock.filling(used, gap):
                    used.update(exact)
                    break
                fits = np.flatnonzero(stock.left(used)[:gap + 1] > 0)
                if not len(fits):
                    break
                used[int(fits[-1])] += 1
                gap -= int(fits[-1])
            copies = min(int(stock.n[length]) // k for length, k in used.items())
            for length, k in used.items():
                stock.n[length] -= copies * k
            if any(stock.n[length] == 0 for length in used):
                stock.index()
            patterns.append((copies, dict(used)))
    return patterns


def segments(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, offset, first sequence),
    sorted: which pieces of a length, by rank, a pattern takes, and where to."""
    rows, rank, sequence = [], Counter(), 0
    for copies, used in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, rank[length], used[length], offset, sequence))
            rank[length] += copies * used[length]
            offset += length * used[length]
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (any columns; ``length`` from 1
    to ``capacity``; ``key`` tells rows apart). ``pieces`` is read twice: pass
    a stored table."""
    pieces = pieces.filter(F.col("length") > 0)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect()}
    if any(length > capacity for length in counts):
        raise ValueError("a piece is longer than a sequence")
    places = segments(plan(counts, capacity))

    # rank within a length: rows numbered in hashed blocks, blocks by their counts
    blocks = max(16, -(-max(counts.values(), default=0) // BLOCK))
    block = F.pmod(F.xxhash64(*key), F.lit(blocks)).alias("_block")
    rows = pieces.select("*", block)
    sizes = rows.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_block").orderBy(*key)
    ranked = (rows.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_block"])
              .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_block", "_base"))
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        import pyarrow as pa

        lengths = places[:, 0]
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                mine = length == one
                at[mine] = starts[one] + np.searchsorted(places[starts[one]:starts[one + 1], 1], rank[mine], "right") - 1
            _, first, k, offset, sequence = places[at].T
            copy, slot = np.divmod(rank - first, k)
            keep = [batch.column(f) for f in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence + copy), pa.array(offset + slot * length)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(run, schema)
