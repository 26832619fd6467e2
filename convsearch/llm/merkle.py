"""Merkle manifest of a dataset, with a witness for every row.

Method: incremental witnesses. A row's digest is appended to its tree, which
keeps the open runs of each level (at most ``ARITY`` - 1 completed siblings).
A node that completes takes the siblings before it as its partial witness, and
extends the witnesses of all rows below those siblings by its own digest; the
last of a run completes the parent, which is appended one level up. A witness
thus never holds more than its row's siblings, level by level, left to right.

The appends are distributed over aligned blocks of ``ARITY ** LEVELS``
consecutive rows of a tree: each block is a complete subtree (the last one of a
tree may be smaller), streamed once, in order, by one task. The roots of the
blocks are appended to further blocks in the same way, round by round, until
each tree has one root; the roots of the trees are then the rows of one more
tree. A row's witness is that of its block's stream followed by those of the
rounds above, which are stored once for each block and joined at the end.

Places in a tree come from a range partition by tree and order (a tree may hold
a third of all rows: it is spread over as many ranges as it needs): the sorted
partitions number their rows, and a table of one row for each range and tree
gives where each range starts.

Defined cases: a field that is null counts as ``-``, so null and empty differ;
a null tree comes before all others, a null order value before all others of
its tree; rows equal in tree and order go by digest, and rows equal in all of
these are interchangeable; an empty table gives no rows; columns other than the
named ones are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import stored

ARITY = 3
#: A block is a subtree of so many levels (729 rows).
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Iterable[Column]) -> Column:
    """The digest (32 bytes) of a row of ``values``."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent(digests: bytes) -> bytes:
    """The digest of a run, given its joined digests: over their hex text."""
    return sha256(digests.hex().encode()).digest()


def depth(n: int, levels: int) -> int:
    """Levels of a block in a tree of ``n`` nodes: all of them, or fewer if the
    tree ends within the block."""
    d = 0
    while d < levels and ARITY ** d < n:
        d += 1
    return d


class Append:
    """One aligned block: ``add`` its digests in order, then ``close`` it."""

    def __init__(self, levels: int):
        self.levels, self.top = levels, b""
        self.open: list[list[tuple[bytes, int]]] = [[] for _ in range(levels)]
        self.witness: list[bytearray] = []

    def add(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        self._completed(0, digest, len(self.witness) - 1)

    def _completed(self, level: int, digest: bytes, first: int) -> None:
        """A node over the rows from ``first`` to the last one is complete."""
        if level == self.levels:
            self.top = digest
            return
        run = self.open[level]
        if run:
            before = b"".join(d for d, _ in run)
            for i in range(first, len(self.witness)):
                self.witness[i] += before
            for i in range(run[0][1], first):
                self.witness[i] += digest
        run.append((digest, first))
        if len(run) == ARITY:
            self._end(level)

    def _end(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._completed(level + 1, parent(b"".join(d for d, _ in run)), run[0][1])

    def close(self) -> bytes:
        """The root of the block; its last runs may be shorter, even single."""
        for level in range(self.levels):
            if self.open[level]:
                self._end(level)
        return self.top


def _with(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *[StructField(n, BinaryType()) for n in names]])


def appended(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, pos, n: nodes in the tree, digest, other columns) with
    the witness within their block and, in a block's first row, its root (top)."""
    size = ARITY ** levels
    names = nodes.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(rows):
            stream = Append(depth(rows.column("n")[0].as_py(), levels))
            for d in rows.column("digest").to_pylist():
                stream.add(d)
            top = stream.close()
            return pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in names), pa.array(map(bytes, stream.witness), pa.binary()), pa.array([top] + [None] * (rows.num_rows - 1), pa.binary())],
                names=[*names, "witness", "top"])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            tree, pos = (batch.column(c).to_numpy() for c in ("tree", "pos"))
            cuts = (np.flatnonzero((np.diff(tree) != 0) | (np.diff(pos // size) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], cuts):
                yield block(batch.slice(a, b - a))
            rest = batch.slice(cuts[-1] if cuts else 0)
        if rest is not None and rest.num_rows:
            yield block(rest)

    schema = _with(nodes.schema, "witness", "top")
    where = F.floor(F.col("pos") / size)
    return nodes.repartition("tree", where).sortWithinPartitions("tree", "pos").mapInArrow(run, schema)


def witnesses(nodes: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, other columns) with ``path``, all their
    siblings up to the root of their tree, and that ``root``. ``most`` is the
    largest n. The rounds of appends are as many as ``most`` asks for."""
    size = ARITY ** levels
    block = F.floor(F.col("pos") / size).cast("long")
    low = stored(appended(nodes, levels), "witnesses")
    tops = low.filter("top is not null").select("tree", block.alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest"))
    if most > size:
        up = witnesses(tops, -(-most // size), levels).select("tree", F.col("pos").alias("_block"), F.col("path").alias("_above"), "root")
    else:
        up = tops.select("tree", F.col("pos").alias("_block"), F.lit(b"").alias("_above"), F.col("digest").alias("root"))
    return low.withColumn("_block", block).join(up, ["tree", "_block"]).select(*nodes.columns, F.concat("witness", "_above").alias("path"), "root")


def numbered(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place among the rows of the same tree, and
    ``n``, their number."""
    by = [F.col(c) for c in (*tree, *order)]
    seq = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_seq", F.monotonically_increasing_id()), "ordered")
    seq = seq.withColumn("_range", F.shiftright("_seq", 33))  # ids count up from the partition's number times 2 ** 33
    whole = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))
    start = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    spans = seq.groupBy(*tree, "_range").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows")).select(
        *[F.col(c).alias(f"_{c}") for c in tree], F.col("_range").alias("_of"), "_first", F.coalesce(start, F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("n"))
    here = seq["_range"] == spans["_of"]
    for c in tree:
        here &= seq[c].eqNullSafe(spans[f"_{c}"])
    return seq.join(spans, here).select(*rows.columns, (F.col("_seq") - F.col("_first") + F.col("_start")).alias("pos"), "n")


def manifest(rows: DataFrame, tree: str, order: str, digest: str, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``pos`` and ``n`` (place and size in the row's tree),
    ``tree`` and ``trees`` (the same of the tree among all trees), ``subroot``,
    ``root`` and ``path``, the joined digests of all siblings up to the root.

    ``rows`` is read several times and should be stored."""
    other = [c for c in rows.columns if c not in (tree, order, digest)]
    if clash := {"tree", "trees", "pos", "n", "path", "root", "subroot", "top", "witness", "digest"} & set(other):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    placed = numbered(rows.withColumn("_any", F.monotonically_increasing_id()), [tree], [order, digest, "_any"]).drop("_any")
    sizes = stored(placed.filter("pos = 0").select(F.col(tree).alias("_name"), F.col("n").alias("_size")), "trees")
    ranks = numbered(sizes, [], ["_name"]).select("_name", F.col("pos").alias("tree"), F.col("n").alias("trees"))
    most, trees = sizes.agg(F.max("_size"), F.count("*")).first()
    nodes = placed.join(ranks, F.col(tree).eqNullSafe(F.col("_name"))).drop("_name")
    known = witnesses(nodes.withColumnRenamed(digest, "digest"), most or 1, levels).withColumnRenamed("root", "subroot")
    tops = known.filter("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("n"), F.col("subroot").alias("digest"))
    above = witnesses(tops, trees or 1, levels).select(F.col("pos").alias("tree"), F.col("path").alias("_above"), "root")
    return known.join(above, "tree").select(
        *[F.col("digest").alias(digest) if c == digest else F.col(c) for c in rows.columns],
        "pos", "n", "tree", "trees", "subroot", "root", F.concat("path", "_above").alias("path"))


def refold(digest: bytes, path: bytes, *places: tuple[int, int]) -> bytes:
    """The root that ``digest`` leads to with the siblings of ``path``, at the
    ``places`` (position, number of nodes) in its tree, then in the tree above."""
    at = 0
    for pos, n in places:
        while n > 1:
            i = pos % ARITY
            others = min(ARITY, n - pos + i) - 1
            digest = parent(path[at:at + 32 * i] + digest + path[at + 32 * i:at + 32 * others])
            at += 32 * others
            pos, n = pos // ARITY, -(-n // ARITY)
    return digest


def verified(rows: DataFrame, digest: str) -> DataFrame:
    """Rows of a manifest with ``folded``, the root recomputed from the column
    ``digest`` and the siblings, and ``verified``: whether it is the root."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (digest, "path", "pos", "n", "tree", "trees")]
            got = pa.array([refold(d, p, (a, b), (x, y)) for d, p, a, b, x, y in zip(*cols)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got], names=[*names, "folded"])

    return rows.mapInArrow(run, _with(rows.schema, "folded")).withColumn("verified", F.col("folded") == F.col("root"))


def tampered_check(docs: DataFrame) -> DataFrame:
    """The manifest of documents (a tree for each source, in order of doc_id)
    checked against a copy in which every document whose decimal doc_id has an
    even crc32 lost the line feeds of its text: doc_id, leaf, subroot, root,
    proof_sha256 (of the joined siblings), folded_root and verified."""
    at = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(at["doc_id"].cast("string")) % 2 == 0) & F.contains(at["text"].cast("string"), F.lit("\n"))
    changed = {**at, "text": F.replace(at["text"].cast("string"), F.lit("\n"), F.lit(""))}
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(at.values()).alias("leaf"),
                              F.when(hit, leaf(changed.values())).alias("given")), "leaves")
    known = manifest(rows, "source", "doc_id", "leaf").withColumn("given", F.coalesce("given", "leaf"))
    text = lambda c: F.lower(F.hex(c))
    return verified(known, "given").select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("path"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), "verified")
