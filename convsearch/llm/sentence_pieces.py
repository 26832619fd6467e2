"""SentencePiece encoding and decoding; giant documents by a max-plus scan.

The model is a byte-pair model of the sentencepiece library. A segmentation is
the library's if and only if each two neighbouring pieces are what the merges
make of the two together, so encoding is a search for the path of admissible
neighbours: a max-plus product, whose weights are 0 or minus infinity for the
neighbours and -1 for each piece.

Method for documents of more than ``giant`` characters: the text is cut at fixed
places into chunks. What a chunk needs to know of the text before it is the
state at its start: the piece that covers the cut and how far it reaches. Each
chunk yields the matrix from the states at its start to those at its end, its
entries the numbers of pieces; matrices are multiplied associatively, first
within blocks of chunks, then over a document's blocks; the scan gives every
chunk its states and the number of pieces before it, and each chunk traces its
own pieces back. Within a chunk no piece crosses the start of a run of spaces,
so whole words between are encoded by the library and states meet there.

Other documents are encoded by the library at once. Both give the library's
ids.

Defined cases: null and empty texts have no ids; characters without a piece are
spelled in bytes; equal texts have equal ids; every row is a document of its
own, whatever its doc_id (null and repeated ones included), told apart by the
number ``row``; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GIANT, CHUNK, BLOCK = 32_768, 4096, 64
MARK = "▁"
ENCODED = "doc_id long, row long, chunk long, first long, ids array<int>"
#: Rows that a worker turns into Python objects at once.
ROWS = 32
_LOADED: dict = {}


class Pieces:
    """A model with what the scan needs: matches, neighbours, words."""

    def __init__(self, path: str, cache: int = 100_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.piece = {i: self.sp.id_to_piece(i) for i in ids}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: self.sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        # whether words can be told apart: no piece has a mark after a letter
        self.words = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.pairs, self.cache = {}, cache

    def merged(self, text: str) -> list[str]:
        """The merges of ``text``: always the best, of equals the first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.score.get(parts[k] + parts[k + 1], float("-inf")), -k))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def admits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow ``a`` (-1: anything)."""
        if a < 0 or b < 0:
            return True
        if (got := self.pairs.get((a, b))) is None:
            x, y = self.piece[a], self.piece[b]
            got = self.pairs[a, b] = self.merged(x + y) == [x, y]
            if len(self.pairs) > self.cache:
                self.pairs.clear()
        return got

    def starts(self, text: str, at: int) -> bool:
        """Whether no piece crosses this place: a word starts, or text ends."""
        return at >= len(text) or at <= 0 or (self.words and text[at] == MARK and text[at - 1] != MARK)

    def at(self, text: str, at: int):
        """(end, id) of the pieces at a place; -1 for a character without."""
        if text[at] not in self.id:
            yield at + 1, -1
            return
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if (i := self.id.get(text[at:end])) is not None:
                yield end, i
            if end < len(text) and self.starts(text, end):
                break

    def word(self, text: str) -> list[int]:
        """Ids of whole words with their marks, by the library."""
        # the library gives an empty text no mark
        return [self.id[MARK]] if text == MARK else self.sp.encode(text[1:].replace(MARK, " "))

    def spelled(self, text: str, start: int, end: int, i: int) -> list[int]:
        return [i] if i >= 0 else [self.sp.piece_to_id(f"<0x{b:02X}>") for b in text[start:end].encode()]

    def paths(self, text: str, start: int, last: int, stop: int):
        """All admissible paths from ``start`` after piece ``last`` to the first
        place not before ``stop``: {(place, piece): ids}. A path that reaches
        the start of a word ends there."""
        open_, ends = {start: {last: ()}}, {}
        while open_:
            here = min(open_)
            for before, ids in open_.pop(here).items():
                if here >= stop or (here > start and self.starts(text, here)):
                    ends[here, -1 if self.starts(text, here) else before] = ids
                    continue
                for end, i in self.at(text, here):
                    if self.admits(before, i):
                        open_.setdefault(end, {})[i] = (ids, here, end, i)
        return ends

    def trace(self, text: str, path) -> list[int]:
        out = []
        while path:
            path, start, end, i = path
            out.append(self.spelled(text, start, end, i))
        return [x for part in reversed(out) for x in part]

    def entering(self, text: str, lo: int) -> list[tuple[int, int]]:
        """The states at a cut: how far a piece reaches beyond it, and which."""
        if self.starts(text, lo):
            return [(0, -1)]
        found, start = set(), lo - 1
        while start >= 0 and start >= lo - self.longest:
            found.update((end - lo, -1 if self.starts(text, end) else i) for end, i in self.at(text, start) if end >= lo)
            if self.starts(text, start):
                break
            start -= 1
        return sorted(found)

    def through(self, text: str, lo: int, hi: int, states, ids: bool) -> list[dict]:
        """For each state at ``lo``: {state at ``hi``: pieces or their number}.
        The ways of all states meet at the next word and go on as one."""
        rests, out = {}, []
        for reach, last in states:
            here = lo + reach
            begin = self.paths(text, here, last, hi) if here < hi and not self.starts(text, here) else {(here, last): ()}
            out.append(new := {})
            for (here, last), path in begin.items():
                got = self.trace(text, path)
                if here >= hi:
                    new[here - hi, last] = got if ids else len(got)
                    continue
                if here not in rests:
                    rests[here] = self.rest(text, here, hi, ids)
                for end, more in rests[here].items():
                    new[end] = got + more if ids else len(got) + more
        return out

    def rest(self, text: str, here: int, hi: int, ids: bool) -> dict:
        """From the start of a word: {state at ``hi``: pieces or their number}.
        The words that end by ``hi`` are encoded by the library in one call."""
        if self.starts(text, hi):
            last = hi
        else:
            last = hi - 1
            while last > here and not self.starts(text, last):
                last -= 1
        got = []
        if last > here:
            # lib words need their mark; a text may start without one
            got = self.word(text[here:last]) if text[here] == MARK else self._only(text, here, last)
        if last >= hi:
            return {(last - hi, -1): got if ids else len(got)}
        out = {}
        for (end, piece), path in self.paths(text, last, -1, hi).items():
            more = self.trace(text, path)
            out[end - hi, piece] = got + more if ids else len(got) + len(more)
        return out

    def _only(self, text: str, here: int, after: int) -> list[int]:
        return self.trace(text, self.paths(text, here, -1, after)[after, -1])


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _code(state: tuple[int, int]) -> int:
    return state[0] * (1 << 24) + state[1] + 1


def _state(code: int) -> tuple[int, int]:
    return code >> 24, (code & ((1 << 24) - 1)) - 1


def product(a: dict, b: dict) -> dict:
    """Max-plus product of {state: {state: -pieces}}."""
    out = {}
    for i, row in a.items():
        new = out.setdefault(i, {})
        for j, x in row.items():
            for k, y in b.get(j, {}).items():
                new[k] = max(new.get(k, float("-inf")), x + y)
    return out


def _dense(rows) -> dict:
    out: dict = {}
    for i, j, n in rows:
        out.setdefault(i, {})[j] = -n
    return out


def _flat(matrix: dict) -> list[tuple[int, int, int]]:
    return [(i, j, -int(n)) for i, row in matrix.items() for j, n in row.items()]


def _few(batches):
    """The rows of ``batches``, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_small(docs: DataFrame, model: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for part in _few(batches):
            ids = pieces_of(model).sp.encode([t or "" for t in part.column(2).to_pylist()], num_threads=1)
            zero = pa.array([0] * len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), zero, zero, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "chunk", "first", "ids"])

    return docs.mapInArrow(run, ENCODED)


def encode_giant(docs: DataFrame, model: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Encode (doc_id, row, text) by the scan, whatever the lengths. ``row``
    must be unique."""
    def cut(batches):
        import pyarrow as pa

        edge = pieces_of(model).longest + 1
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = MARK + text.as_py().replace(" ", MARK)
                cuts = range(0, len(text), chunk)
                for some in (cuts[a:a + ROWS] for a in range(0, len(cuts), ROWS)):
                    rows = [(doc, row, lo // chunk, max(0, lo - edge), lo, min(len(text), lo + chunk), len(text), text[max(0, lo - edge):lo + chunk + edge]) for lo in some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 7, pa.string()])],
                                                     names=["doc_id", "row", "chunk", "base", "lo", "hi", "size", "text"])

    def matrices(batches):
        import pyarrow as pa

        p, kind = pieces_of(model), pa.list_(pa.struct([("i", pa.int64()), ("o", pa.int64()), ("n", pa.int64())]))
        for part in _few(batches):
            out = []
            for r in part.to_pylist():
                lo, hi = r["lo"] - r["base"], r["hi"] - r["base"]
                states = p.entering(r["text"], lo)
                ways = p.through(r["text"], lo, hi, states, False)
                out.append([{"i": _code(s), "o": _code(e), "n": n} for s, way in zip(states, ways) for e, n in way.items()])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("chunk"), pa.array(out, kind)], names=["row", "chunk", "m"])

    entries = "array<struct<i:long,o:long,n:long>>"
    # a given count: the rows are small but costly, and would be merged into few tasks
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(docs.select("doc_id", "row", "text").mapInArrow(cut, "doc_id long, row long, chunk long, base long, lo long, hi long, size long, text string")
                    .repartition(tasks, "row", "chunk"), "chunks")
    found = stored(chunks.mapInArrow(matrices, f"row long, chunk long, m {entries}").withColumn("block", F.floor(F.col("chunk") / block)), "matrices")

    def multiply(pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk")
        total = None
        for m in pdf["m"]:
            one = _dense((e["i"], e["o"], e["n"]) for e in m)
            total = one if total is None else product(total, one)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "block": [pdf["block"].iloc[0]], "m": [[{"i": i, "o": o, "n": n} for i, o, n in _flat(total)]]})

    def sweep(pdf, at: str):
        """States and pieces before each row, given those before the first."""
        import pandas as pd

        pdf = pdf.sort_values(at)
        rows = [_dense((e["i"], e["o"], e["n"]) for e in m) for m in pdf["m"]]
        first, goal = (int(pdf[c].iloc[0]) for c in ("enter", "leave"))
        # forward: best value of each state; backward from the goal: the path
        states, trail = {first: 0}, []
        for m in rows:
            trail.append(states)
            states = product({0: states}, m).get(0, {})
        ways = []
        for m, before in zip(reversed(rows), reversed(trail)):
            ways.append((goal_in := max((v + m[s][goal], s) for s, v in before.items() if goal in m.get(s, {}))[1], goal, -before[goal_in]))
            goal = goal_in
        ways.reverse()
        base = int(pdf["before"].iloc[0])
        return pd.DataFrame({"row": pdf["row"], at: pdf[at], "enter": [w[0] for w in ways], "leave": [w[1] for w in ways], "before": [base + int(w[2]) for w in ways]})

    blocks = found.repartition(tasks, "row", "block").groupBy("row", "block").applyInPandas(multiply, f"row long, block long, m {entries}")
    whole = F.lit(_code((0, -1))).cast("long")
    # a document's blocks are few: one for every chunk * block characters
    spans = (blocks.select("*", whole.alias("enter"), whole.alias("leave"), F.lit(0).cast("long").alias("before"))
             .groupBy("row").applyInPandas(lambda pdf: sweep(pdf, "block"), "row long, block long, enter long, leave long, before long"))
    ways = (found.join(spans, ["row", "block"]).repartition(tasks, "row", "block").groupBy("row", "block")
            .applyInPandas(lambda pdf: sweep(pdf, "chunk"), "row long, chunk long, enter long, leave long, before long"))

    def back(batches):
        import pyarrow as pa

        p = pieces_of(model)
        for part in _few(batches):
            ids = [p.through(r["text"], r["lo"] - r["base"], r["hi"] - r["base"], [_state(r["enter"])], True)[0][_state(r["leave"])] for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "row", "chunk", "before")), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "row", "chunk", "first", "ids"])

    return chunks.join(ways, ["row", "chunk"]).repartition(tasks, "row", "chunk").mapInArrow(back, ENCODED)


def encode(docs: DataFrame, model: str, giant: int = GIANT) -> DataFrame:
    """doc_id, row, chunk, first (pieces before the chunk) and ids of all rows:
    one for each chunk of a giant document, one for any other."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    return encode_small(docs.filter(~long), model).unionByName(encode_giant(docs.filter(long), model))


def _text(sp, chunk: int, ids: list[int]) -> str:
    # the library drops the first mark: give other chunks one more
    return sp.decode(ids) if chunk == 0 else sp.decode([sp.piece_to_id(MARK), *ids])


def decode_chunks(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, row, chunk and text of each row of ids: ids of a chunk are whole
    characters. The mark put before a document is taken off."""
    def run(batches):
        import pyarrow as pa

        sp = pieces_of(model).sp
        for part in _few(batches):
            out = [_text(sp, k, ids) for k, ids in zip(part.column(2).to_pylist(), part.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(out, pa.string())], names=["doc_id", "row", "chunk", "text"])

    return encoded.select("doc_id", "row", "chunk", "first", "ids").mapInArrow(run, "doc_id long, row long, chunk long, text string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every document."""
    parts = decode_chunks(encoded, model).groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts")["text"], "").alias("text"))


def digest(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sum (of (place + 1) * (id + 1), modulo 2^61 - 1)
    and n_chars of the decoded text of every document."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        sp = pieces_of(model).sp
        for part in _few(batches):
            rows = []
            for k, first, ids in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4)):
                x = ids.values.to_numpy().astype(np.int64)
                rows.append((len(x), int(((np.arange(len(x)) + first + 1) * (x + 1)).sum()), len(_text(sp, k, x.tolist()))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "row", "n", "s", "c"])

    parts = encoded.select("doc_id", "row", "chunk", "first", "ids").mapInArrow(run, "doc_id long, row long, n long, s long, c long")
    return parts.groupBy("doc_id", "row").agg(
        F.sum("n").alias("n_tokens"), (F.sum(F.col("s").cast("decimal(38,0)")) % F.lit((1 << 61) - 1)).cast("long").alias("ids_sum"), F.sum("c").alias("n_chars")).drop("row")
