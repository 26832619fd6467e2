"""Line deduplication over all documents, giving keep bitmaps.

Method: the key of every line long enough is hashed (128 bits); the hashes are
range-partitioned with a secondary sort by document and position, so that each
task streams the occurrences of a key from the document that keeps it on. A
line found in ``min_docs`` documents is dropped from all but the first document
in that order, the largest doc_id. What comes back is no text but, for each
document that loses a line, a compressed bitmap of the lines to keep.

A key may hold a third of all lines: the ranges go by hash, document and
position, so its run is cut over as many tasks as it needs. A task decides every
run that begins and ends inside its range. Of the two runs at its edges it
gives the rows undecided and one summary row; the summaries (two a task, hence
their broadcast is bounded) tell each such key's documents and the one that
keeps it.

A key is a line without the white space (space, U+0009-U+000D) at both ends,
A-Z lower-cased; its length is in code points.

Defined cases: a null text is one empty line, like an empty one; a document is
a doc_id, so rows with equal doc_id count as one document (nulls together, as
the smallest) and all keep or lose a line alike, wherever it stands in them; a
line repeated within the keeping document stays each time; an empty table gives
no rows; columns other than doc_id and text are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: bytes) -> bytes:
    """The key of a line of UTF-8; only ASCII is stripped and lower-cased."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points (1 to 4 bytes each)."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (which tells rows of equal doc_id apart) and
    the text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc_id, text_hash, pos) of every line with a long key."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                digests, rows, places = [], [], []
                for i, text in enumerate(part.column(2)):
                    for pos, line in enumerate(text.as_py().split(b"\n")):
                        if len(line) >= min_chars and _long(key := line_key(line), min_chars):
                            digests.append(xxh3_128_digest(key))
                            rows.append(i)
                            places.append(pos)
                if not rows:
                    continue
                hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), part.column(0).take(at), part.column(1).take(at), pa.array(places, pa.int32())],
                    names=["high", "low", "doc_id", "text_hash", "pos"])

    return _identified(docs).mapInArrow(run, "high long, low long, doc_id long, text_hash long, pos int")


STREAMED = "kind int, range int, high long, low long, doc_id long, text_hash long, pos int, docs long, last long"
DROP, OPEN, EDGE = 0, 1, 2


def streamed(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of three kinds: lines to drop; lines of a run at an edge of the
    range that its range cannot decide; and, for the first and the last run of
    a range, their documents there (number, first as ``doc_id``, last)."""
    order = [F.col("high"), F.col("low"), F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("pos")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64()]
        names = ["kind", "range", "high", "low", "doc_id", "text_hash", "pos", "docs", "last"]
        here = TaskContext.get().partitionId()

        def given(kind, rows, keyed=False):
            n = rows.num_rows
            head = [pa.array(np.full(n, x, np.int32)) for x in (kind, here)]
            key = [rows.column(c) if keyed else pa.nulls(n, pa.int64()) for c in ("high", "low")]
            return pa.RecordBatch.from_arrays([*head, *key, *(rows.column(c) for c in ("doc_id", "text_hash", "pos")), *[pa.nulls(n, pa.int64())] * 2], names=names)

        def edge(open_):
            values = [EDGE, here, *open_["key"], open_["first"], None, None, open_["docs"], open_["last"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        # the run that the last batch ended in; ``held`` are its rows of documents
        # after the first, while there are too few of them to drop any: at most
        # the lines of ``min_docs`` - 2 documents
        open_, held, begun = None, [], False
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low = (batch.column(c).to_numpy() for c in ("high", "low"))
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc = np.where(null, 0, batch.column("doc_id").fill_null(0).to_numpy())
            changes = lambda x, before: np.concatenate([[x[0] != before], x[1:] != x[:-1]])
            at = open_["key"] if open_ else (None, None)
            new_key = changes(high, at[0]) | changes(low, at[1])
            of = lambda i: None if null[i] else int(doc[i])
            new_doc = new_key.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            new_doc[0] |= open_ is not None and open_["last"] != of(0)
            starts = np.flatnonzero(new_key)
            run_of = np.cumsum(new_key) - new_key[0]  # runs of this batch, from 0
            first_rows = starts if new_key[0] else np.concatenate([[0], starts])
            seen = np.cumsum(new_doc)  # the place of a row's document in its run, from 1
            base = seen[first_rows] - 1
            if not new_key[0]:
                base[0] = -open_["docs"]
            nth = seen - base[run_of]
            total = nth[np.append(first_rows[1:], len(nth)) - 1]
            if new_key[0] and open_:  # the run before has ended at the batch's edge
                if not begun:
                    yield edge(open_)
                    begun = True
                held = []
            if not begun:  # the range's first run: another range may hold its start
                n = int(first_rows[1]) if len(first_rows) > 1 else batch.num_rows
                yield given(OPEN, batch.slice(0, n), True)
            drop = (nth >= 2) & (total[run_of] >= min_docs)
            if not begun:
                drop &= run_of > 0
            elif not new_key[0] and total[0] >= min_docs:
                yield from (given(DROP, x) for x in held)
                held = []
            if drop.any():
                yield given(DROP, batch.filter(pa.array(drop)))
            ended = len(first_rows) > 1
            if ended or new_key[0]:
                if not begun and ended:
                    old = open_ if not new_key[0] else {"key": (int(high[0]), int(low[0])), "first": of(0)}
                    yield edge({**old, "docs": int(total[0]), "last": of(first_rows[1] - 1)})
                    begun = True
                if ended:
                    held = []
                a = int(first_rows[-1])
                open_ = {"key": (int(high[a]), int(low[a])), "first": of(a)}
            open_ |= {"docs": int(total[-1]), "last": of(len(doc) - 1)}
            if begun and total[-1] < min_docs:
                wait = (nth >= 2) & (run_of == run_of[-1])
                if wait.any():
                    held.append(batch.filter(pa.array(wait)))
        if open_:
            yield from (given(OPEN, x, True) for x in held)
            yield edge(open_)

    return lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, STREAMED)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos) of every line to drop."""
    rows = stored(streamed(stored(line_hashes(docs, min_chars), "lines"), min_docs), "streamed")
    key, place = Window.partitionBy("high", "low"), ["doc_id", "text_hash", "pos"]
    before = F.lag(F.struct("last")).over(key.orderBy("range"))
    # one document may stand on both sides of a cut
    twice = (before.isNotNull() & before["last"].eqNullSafe(F.col("doc_id"))).cast("long")
    edges = rows.filter(F.col("kind") == EDGE).withColumn("docs", F.col("docs") - twice)
    found = edges.groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.min_by("doc_id", "range").alias("keeper")).filter(F.col("docs") >= min_docs)
    late = (rows.filter(F.col("kind") == OPEN).drop("docs").join(F.broadcast(found), ["high", "low"])  # two keys a range at most
            .filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    return rows.filter(F.col("kind") == DROP).select(*place).unionByName(late.select(*place))


def bitmap(dropped: list[int]) -> bytes:
    """The keep bitmap of a document: whole bytes up to the last line dropped, a
    bit for each line, 1 to keep it, the first line in the lowest bit; all lines
    beyond stay. Compressed by zlib."""
    import zlib

    import numpy as np

    bits = np.ones((max(dropped) // 8 + 1) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept(lines: list, packed: bytes | None) -> list:
    """Those of ``lines`` that the bitmap keeps."""
    if packed is None:
        return lines
    import zlib

    import numpy as np

    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")
    bits = np.concatenate([bits[:len(lines)], np.ones(max(0, len(lines) - len(bits)), np.uint8)])
    return [x for x, keep in zip(lines, bits.tolist()) if keep]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_dropped and the bitmap of each document (and text,
    if doc_ids are repeated) that loses a line."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            places = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in places], pa.int64()), pa.array([bitmap(x) for x in places], pa.binary())],
                                             names=["doc_id", "text_hash", "n_dropped", "keep"])

    # what is gathered are the lines of one document
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("pos"))
    return stored(gone.mapInArrow(run, "doc_id long, text_hash long, n_dropped long, keep binary"), "bitmaps")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    own = _identified(docs)
    return own.join(bitmaps, own["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (own["text_hash"] == bitmaps["text_hash"]), "left").select(own["doc_id"], "text", "keep")


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and text of every row without the lines that its bitmap drops."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                texts = [b"\n".join(kept(t.as_py().split(b"\n"), k.as_py())).decode() for t, k in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _with_bitmaps(docs, bitmaps).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for batch in batches:
            rows = []
            for t, k in zip(batch.column(1), batch.column(2)):
                lines = (text := t.as_py()).split(b"\n")
                left = lines if k.as_py() is None else kept(lines, k.as_py())
                rows.append((len(lines), len(lines) - len(left), sha256(text if left is lines else b"\n".join(left)).hexdigest()))
            n, gone, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_bitmaps(docs, bitmaps).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
