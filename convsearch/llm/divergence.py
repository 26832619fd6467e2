"""Source divergence audit: how far the term shares of the sources of a
language lie apart, and which terms a source overuses.

Method: the matrix of counts, a row for each source and a column for each kept
term of a language, is held as a K-squared tree: a square of cells is divided
into K * K quadrants, level by level; a quadrant without a count is one 0 bit
and has nothing below, a nonzero leaf is one cell. As there are far more terms
than sources, a language is a forest of such squares, and squares are dealt
over tasks. The sum of differences of two sources is read off by descending
their two rows of quadrants together: where both are zero, all their cells are
priced at once (their number times the difference of the two shares of an
absent term), where one is zero only the other is descended, and leaves are
priced one by one. The descent goes over all pairs of rows of quadrants at
once, from the roots on, so what sources have in common is visited once for
whole groups of pairs.

Sources of a language are cut into blocks of ``ROWS``; a task gets the cells of
two blocks in some thousand columns, so neither many sources nor many terms
meet in one task, and a hot source is no more than one row.

Shares are whole numbers (parts of 10^9, rounded down, plus 1) of the count
with ``SMOOTH`` added; they and the sums are exact.

Terms are runs of letters A-Z, a-z and all characters beyond ASCII; only A-Z is
lower-cased. Kept are the terms in ``MIN_DOCS`` documents of the language.

Defined cases: null text, language or source count as the empty string; every
row is a document, repeated or not; a source without kept terms has the shares
of absent terms; a language without kept terms gives sums of 0; ties of a rank
go by the item's UTF-8 bytes; a language with one source has no pairs; an empty
table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
K, ROWS, COLUMNS = 2, 128, 4096
#: Pairs of quadrants descended at once.
CHUNK = 1 << 17
#: Terms that a task counts before it passes the counts on.
HELD = 200_000


def term_bytes() -> bytes:
    """For each byte of UTF-8 what it counts as: letters A-Z as a-z, a-z and
    bytes beyond ASCII as they are, all others as a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _parts(text: bytes, size: int = 1 << 20):
    """``text`` in parts of about ``size``, cut at spaces."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of
    each source; a row without a term for each source."""
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        table, held = term_bytes(), {}

        def given():
            rows = [(*group, term, n, has[term]) for group, (all_, has) in held.items() for term, n in all_.items()]
            rows += [(*group, None, 0, 0) for group in held]
            held.clear()
            cols = list(zip(*rows))
            kinds = [*[pa.binary()] * 3, pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            return pa.RecordBatch.from_arrays([*(a.cast(pa.string()) for a in arrays[:3]), *arrays[3:]], names=["lang", "source", "term", "n", "docs"])

        n_held = 0
        for batch in batches:
            for lang, source, text in zip(*(c for c in batch.columns)):
                key = (lang.as_py(), source.as_py())
                if key not in held:
                    held[key] = (Counter(), Counter())
                all_, has = held[key]
                was, seen = len(all_), set()
                for part in _parts(text.as_py().translate(table)):
                    terms = part.split()
                    all_.update(terms)
                    seen.update(terms)
                has.update(seen)
                n_held += len(all_) - was + 1
                if n_held >= HELD:
                    yield given()
                    n_held = 0
        if held:
            yield given()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count, total, terms: int):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact in
    64 bits: a long division, three decimals at a time."""
    rest, by = np.asarray(count, np.int64) + SMOOTH, np.asarray(total, np.int64) + SMOOTH * terms
    if terms == 0:
        return np.ones_like(rest)
    out = rest // by * SCALE
    rest, digits = rest % by, 0
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // by, rest % by
    return 1 + out + digits


class Forest:
    """The K-squared trees of the cells (row, column) of a matrix. Each node has
    K * K bits; that of a nonzero quadrant leads to the node at the next level
    whose number is the rank of the bit (``child``; -1: zeros only)."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int, squares: int):
        side, self.height = K ** height, height
        code = columns // side  # the square, then the quadrant at each level
        r, c = rows, columns % side
        for level in range(height - 1, -1, -1):
            code = code * (K * K) + r // K ** level % K * K + c // K ** level % K
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        nodes = [np.unique(code // (K * K) ** (height - level)) for level in range(height)] + [code]
        self.root = np.full(squares, -1)
        self.root[nodes[0]] = np.arange(len(nodes[0]))
        self.child = []
        for up, down in zip(nodes, nodes[1:]):
            bits = np.zeros((len(up) + 1) * K * K, bool)  # the last ones are those of node -1
            bits[np.searchsorted(up, down // (K * K)) * (K * K) + down % (K * K)] = True
            self.child.append(np.where(bits, np.cumsum(bits) - 1, -1))  # the rank of the bit

    def below(self, node: np.ndarray, level: int, row: int, column: int) -> np.ndarray:
        """The quadrants at ``row`` and ``column`` of the given nodes."""
        return self.child[level][node * (K * K) + row * K + column]


def differences(a: Forest, b: Forest, value_a, value_b, zero_a, zero_b, squares: int) -> np.ndarray:
    """For each row of ``a`` and each of ``b`` the sum, over all columns of all
    squares, of the absolute difference of their values. The values of leaves
    are given in their order, ``zero_*`` (one for each row) is that of a zero.
    Of one forest with itself, only rows i < j are filled in."""
    height, same = a.height, a is b
    na, nb = len(zero_a), len(zero_b)
    out = np.zeros((na, nb), np.int64)
    absent = [np.zeros((K ** level, K ** level), np.int64) for level in range(height + 1)]
    start = np.arange(squares)
    work = [(0, a.root[start], b.root[start], np.zeros(squares, np.int64), np.zeros(squares, np.int64))]
    while work:
        level, x, y, i, j = work.pop()
        if len(x) > CHUNK:
            half = len(x) // 2
            work += [(level, x[:half], y[:half], i[:half], j[:half]), (level, x[half:], y[half:], i[half:], j[half:])]
            continue
        zero = (x < 0) & (y < 0)
        if zero.any():  # priced below, with all others of these rows
            np.add.at(absent[level], (i[zero], j[zero]), K ** (height - level))
            x, y, i, j = (v[~zero] for v in (x, y, i, j))
        if not len(x):
            continue
        if level == height:
            va, vb = np.where(x < 0, zero_a[i], value_a[x]), np.where(y < 0, zero_b[j], value_b[y])
            np.add.at(out, (i, j), np.abs(va - vb))
            continue
        size = K ** (height - level - 1)  # rows of a quadrant
        parts = []
        for column in range(K):
            left = [a.below(x, level, r, column) for r in range(K)]
            right = [b.below(y, level, r, column) for r in range(K)]
            for r in range(K):
                for s in range(K):
                    p, q = i * K + r, j * K + s
                    real = (p * size < na) & (q * size < nb)
                    if same:  # pairs once, and none of a row with itself
                        real &= p <= q if size > 1 else p < q
                    parts.append([v[real] for v in (left[r], right[s], p, q)])
        work.append((level + 1, *(np.concatenate(v) for v in zip(*parts))))
    apart = np.abs(zero_a[:, None] - zero_b[None, :])
    for level, cols in enumerate(absent):
        size = K ** (height - level)
        out += np.repeat(np.repeat(cols, size, 0), size, 1)[:na, :nb] * apart
    return np.triu(out, 1) if same else out


def _unit(key, got, groups, top: int, rows: int):
    """What one task tells of some columns and two blocks of sources: sums of
    differences and, if both blocks are the same, the ``top`` terms that each
    of its sources overuses most."""
    import pyarrow as pa

    lang, _, first, second = (k.as_py() for k in key)
    col = lambda t, c: t.column(c).to_numpy()
    sides = []
    term = got.column("term").combine_chunks().dictionary_encode() if got.num_rows else None
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    column = term.indices.to_numpy().astype(np.int64) if got.num_rows else np.empty(0, np.int64)
    n_columns, terms = len(term.dictionary) if got.num_rows else 0, int(col(groups, "terms")[0])
    height = 0
    most = max(int((col(groups, "row") - col(groups, "block") * rows).max()) + 1, 1)
    while K ** height < most:
        height += 1
    squares = -(-n_columns // K ** height)
    out = []
    for block in dict.fromkeys((first, second)):
        mine, here = col(groups, "block") == block, (col(got, "block") == block if got.num_rows else np.empty(0, bool))
        row, total = col(groups, "row")[mine], col(groups, "total")[mine]
        by = np.argsort(row)
        row, total = row[by] - block * rows, total[by]
        at, n = (col(got, "row")[here] - block * rows, col(got, "n")[here]) if got.num_rows else (np.empty(0, np.int64),) * 2
        forest = Forest(at, column[here], height, squares)
        value = shares(n, total[at], terms) if len(at) else np.empty(0, np.int64)
        sides.append((forest, np.append(value[forest.order], 0), shares(np.zeros(len(row)), total, terms), block))
        if first == second and got.num_rows:
            q = shares(col(got, "all_n"), int(col(groups, "lang_total")[0]), terms)[here]
            over = value - q
            names, found = term.dictionary, np.flatnonzero(over > 0)
            text = np.array([names[c].as_py().encode() for c in column[here][found]], object)
            for i in np.unique(at[found]):
                own = np.flatnonzero(at[found] == i)
                best = sorted(zip((-over[found][own]).tolist(), text[own].tolist()))[:top]
                out += [(lang, int(i) + block * rows, None, t.decode(), -v) for v, t in best]
    (fa, va, za, ba), (fb, vb, zb, bb) = sides[0], sides[-1]
    if terms:
        # the last square may have room for more columns than there are; terms of
        # the tile that no source of these blocks has are priced here
        sums = differences(fa, fb, va, vb, za, zb, squares)
        apart = np.abs(za[:, None] - zb[None, :])
        sums = sums + (np.triu(apart, 1) if ba == bb else apart) * (int(col(groups, "tile_terms")[0]) - squares * K ** height)
        i, j = np.triu_indices(len(za), 1) if ba == bb else np.indices(sums.shape).reshape(2, -1)
        out += [(lang, int(x) + ba * rows, int(y) + bb * rows, None, int(v)) for x, y, v in zip(i, j, sums[i, j])]
    cols = list(zip(*out)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                                names=["lang", "row", "other", "term", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value and rank: in the part ``pair`` all other
    sources of the language, in the part ``term`` the ``top`` terms. A task gets
    two blocks of ``rows`` sources and about ``columns`` terms."""
    counted = stored(cells(docs), "cells")
    every = Window.partitionBy("lang", "term")
    kept = stored(counted.filter("term is not null").withColumn("all_docs", F.sum("docs").over(every)).withColumn("all_n", F.sum("n").over(every))
                  .filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n"), "kept")
    langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row for each source of a language
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")],
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("row"))
    groups = stored(groups.select("*", F.floor(F.col("row") / rows).alias("block"), F.ceil(F.col("terms") / columns).alias("tiles"),
                                  F.floor((F.max("row").over(Window.partitionBy("lang")) / rows)).alias("last_block")), "groups")

    with_row = kept.join(groups.select("lang", "source", "row", "block", "tiles", "last_block"), ["lang", "source"])
    tile = F.pmod(F.xxhash64("term"), F.col("tiles"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block")))
    pair = lambda df: df.withColumn("partner", partner).withColumn("first", F.least("block", "partner")).withColumn("second", F.greatest("block", "partner"))
    unit = ["lang", "tile", "first", "second"]
    placed = with_row.withColumn("tile", tile)
    in_tile = placed.groupBy("lang", "tile", "term").agg(F.lit(1)).groupBy("lang", "tile").agg(F.count("*").alias("tile_terms"))
    got = pair(placed).select(*unit, "block", "row", "term", "n", "all_n")
    sides = pair(groups.join(in_tile, "lang")).select(*[F.col(c).alias(c) for c in (*unit, "block", "row", "total", "terms", "lang_total", "tile_terms")])
    told = stored(got.groupBy(*unit).cogroup(sides.groupBy(*unit)).applyInArrow(
        lambda key, a, b: _unit(key, a, b, top, rows), "lang string, row long, other long, term string, value long"), "told")

    name = lambda row, as_: groups.select("lang", F.col("row").alias(row), F.col("source").alias(as_))
    known = told.filter("other is not null").groupBy("lang", "row", "other").agg(F.sum("value").alias("value"))
    if groups.filter("tiles = 0").limit(1).count():  # no kept term: every sum is 0
        bare = groups.filter("tiles = 0").select("lang", "row", F.col("last_block"))
        known = known.unionByName(bare.join(bare.select("lang", F.col("row").alias("other")), "lang").filter("row < other").select("lang", "row", "other", F.lit(0).cast("long").alias("value")))
    both = known.select("lang", "value", F.explode(F.array(F.struct("row", "other"), F.struct(F.col("other").alias("row"), F.col("row").alias("other")))).alias("p")).select("lang", "p.*", "value")
    pairs = both.join(name("other", "item"), ["lang", "other"]).select("lang", "row", F.lit("pair").alias("part"), "item", "value")
    terms = told.filter("other is null").select("lang", "row", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = Window.partitionBy("lang", "row", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(place)).unionByName(
        terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top))
    return ranked.join(name("row", "source"), ["lang", "row"]).select("lang", "source", "part", "item", "value", "rank")
