"""Merkle manifest, line deduplication and source divergence against plain
Python on small tables with every edge case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from convsearch.llm import divergence, line_dedup, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, tree string, last string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, arity=3):
    """Leaf, subroot, root, proof, folded root and verified, by the definition."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: sha(*map(field, (d, s, lang, n, t)))
    trees = collections.defaultdict(list)
    for d, t, lang, s, n in rows:
        hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0
        trees[s].append((d, leaf(d, t, lang, s, n), leaf(d, t.replace("\n", "") if hit else t, lang, s, n)))

    def climb(nodes):
        """(root, for each node the list of (index in its run, siblings))"""
        ways, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(level) > 1:
            runs = [level[i:i + arity] for i in range(0, len(level), arity)]
            for way, i in zip(ways, at):
                run = runs[i // arity]
                way.append((i % arity, run[:i % arity] + run[i % arity + 1:]))
            at, level = [i // arity for i in at], [sha(*r) for r in runs]
        return level[0], ways

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = climb([r[1] for r in trees[s]])
    root, above = climb([built[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (d, own, given), way in zip(trees[s], built[s][1]):
            proof, folded = "", given
            for i, others in way + up:
                proof += "".join(others)
                folded = sha(*others[:i], folded, *others[i:])
            out.append((d, own, built[s][0], root, sha(proof), folded, folded == root))
    return out


def documents(n, seed=1):
    rng = np.random.default_rng(seed)
    lines = ["A line that many documents share", "  a LINE that many documents share\t", "short", "", "Üñï " * 5, "ein ganz anderer Satz hier", "x" * 20, "x" * 19]
    rows = []
    for i in range(n):
        text = "\n".join(lines[k] if k < len(lines) else f"its own line number {i} {k}" for k in rng.integers(0, 12, int(rng.integers(0, 7))))
        rows.append((i * 3 + 1, text, "en" if i % 3 else "de", f"s{int(rng.integers(0, 9))}" if i % 2 else "hot", len(text)))
    return rows


EDGE = [(5, None, None, None, None), (5, None, None, None, None), (5, "a\nb", "", "", 3), (5, "a\nb", "en", "", 3), (None, "\n\nx", "en", None, 1), (None, "A line that many documents share", "en", "hot", 1),
        (10 ** 12, "A line that many documents share\nA line that many documents share\nend", "en", "é", 1), (7, "", "en", "é", 0), (-4, "long " * 20_000, "en", "zz", 5)]


@pytest.mark.parametrize("rows", [EDGE, documents(1), documents(40), documents(90, 3) + EDGE, []], ids=["edge", "one", "some", "more", "empty"])
def test_manifest_equals_definition(spark, rows):
    got = [tuple(r) for r in merkle.tampered_check(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows) if rows else [], key=str)


def test_manifest_over_many_blocks(spark):
    """Blocks of 9: five rounds of appends over a tree of 400 documents."""
    rows = [(i, f"t{i}", "en", "hot" if i < 400 else f"s{i % 17}", 1) for i in range(450)]
    leaves = table(spark, rows).repartition(7).select("doc_id", "source", merkle.leaf([*map(merkle.F.col, merkle.FIELDS)]).alias("leaf"))
    got = merkle.manifest(leaves, "source", "doc_id", "leaf", levels=2).collect()
    want = {r[0]: r for r in plain_manifest(rows)}
    assert len(got) == 450
    for r in got:
        assert (r.leaf.hex(), r.subroot.hex(), r.root.hex(), sha(r.path.hex())) == want[r.doc_id][1:5]
        assert merkle.refold(r.leaf, r.path, (r.pos, r.n), (r.tree, r.trees)) == r.root
        assert merkle.refold(r.leaf[::-1], r.path, (r.pos, r.n), (r.tree, r.trees)) != r.root


def test_append_keeps_only_open_siblings():
    stream = merkle.Append(5)
    for i in range(200):
        stream.add(hashlib.sha256(str(i).encode()).digest())
        assert sum(map(len, stream.open)) <= 5 * (merkle.ARITY - 1)
    assert {len(w) % 32 for w in stream.witness} == {0} and len(stream.close()) == 32


def test_manifest_refuses_clashing_results(spark):
    with pytest.raises(ValueError, match="pos"):
        merkle.manifest(table(spark, EDGE), "source", "doc_id", "leaf")


def plain_dedup(rows, least=20, docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    where = collections.defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where[key(line)].add(d)
    keeper = {k: max(v, key=lambda d: (d is not None, d or 0)) for k, v in where.items() if len(v) >= docs}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keeper.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 23])
@pytest.mark.parametrize("rows", [EDGE, documents(300) + EDGE, documents(60, 2) * 2 + EDGE, []], ids=["edge", "many", "repeated", "empty"])
def test_line_dedup_equals_definition(spark, rows, parts):
    """With many ranges, each frequent key crosses several of them."""
    docs = table(spark, rows).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bitmaps = line_dedup.keep_bitmaps(docs)
        got = [tuple(r) for r in line_dedup.digest(docs, bitmaps).collect()]
        texts = [tuple(r) for r in line_dedup.deduplicated(docs, bitmaps).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain_dedup(rows)
    assert sorted(got, key=str) == sorted([r[:4] for r in want], key=str)
    assert sorted(texts, key=str) == sorted([(r[0], r[4]) for r in want], key=str)
    assert bitmaps.count() == len({(r[0], w[1]) for r, w in zip(want, rows) if r[2]})


def test_runs_over_batches_and_ranges(spark):
    """Keys of every number of documents and lines, in batches of few rows."""
    rng = np.random.default_rng(0)
    rows = [(int(h), 0, int(d), 0, p) for h in range(40) for d in rng.integers(0, 9, int(rng.integers(1, 8))) for p in range(int(rng.integers(1, 4)))]
    rows = sorted(set(rows))
    want = collections.defaultdict(set)
    for h, _, d, _, _ in rows:
        want[h].add(d)
    lines = spark.createDataFrame(rows, "high long, low long, doc_id long, text_hash long, pos int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 2, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = line_dedup.streamed(lines).collect()
            gone = collections.Counter((r.doc_id, r.pos) for r in got if r.kind == line_dedup.DROP)
            edges = [r for r in got if r.kind == line_dedup.EDGE]
            inner = set(want) - {r.high for r in edges}
            sure = collections.Counter((d, p) for h, _, d, _, p in rows if h in inner and len(want[h]) >= 3 and d != max(want[h]))
            assert not sure - gone and len(edges) <= 2 * n
            late = {r.high for r in edges}
            assert {(r.high, r.doc_id, r.pos) for r in got if r.kind == line_dedup.OPEN} <= {(h, d, p) for h, _, d, _, p in rows if h in late}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmap_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 100, 1000):
        gone = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
        assert line_dedup.kept(list(range(n)), line_dedup.bitmap(gone)) == [i for i in range(n) if i not in set(gone)]
    assert len(line_dedup.bitmap(list(range(0, 80_000, 2)))) < 100


def plain_audit(rows, least, top):
    docs = [(lang or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, s, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        has, groups = collections.Counter(), {}
        for _, s, w in (d for d in docs if d[0] == lang):
            has.update(set(w))
            groups.setdefault(s, collections.Counter()).update(w)
        kept = [t for t, n in has.items() if n >= least]
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), collections.Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return out


@pytest.mark.parametrize("rows,least", [(documents(200) + EDGE, 30), (documents(200) + EDGE * 3, 3), (EDGE, 30), (documents(30), 1), ([], 30)], ids=["kept", "rare", "none", "all", "empty"])
def test_audit_equals_definition(spark, rows, least):
    got = [tuple(r) for r in divergence.audit(table(spark, rows), least, 7).collect()]
    assert sorted(got) == sorted(plain_audit(rows, least, 7))


def test_audit_over_blocks_of_sources_and_tiles(spark):
    """Three blocks of sources and many tiles of columns, some of which a block
    has no cell in."""
    rng = np.random.default_rng(4)
    name = lambda k: "".join(chr(97 + int(x)) for x in str(int(k)))
    rows = [(i, " ".join(name(k) for k in rng.integers(0, 40, 9)) + " " + name(100 + i % 11), "en", f"s{i % 11}", 1) for i in range(150)]
    got = [tuple(r) for r in divergence.audit(table(spark, rows), 2, 50, rows=4, columns=3).collect()]
    assert sorted(got) == sorted(plain_audit(rows, 2, 50))


def test_forest_descends_every_shape():
    rng = np.random.default_rng(9)
    for n, m, columns, height in ((1, 1, 5, 0), (3, 3, 40, 2), (7, 5, 33, 3), (8, 8, 100, 3)):
        squares = -(-columns // divergence.K ** height)
        width = squares * divergence.K ** height
        sides = []
        for rows in (n, m):
            dense = rng.integers(1, 50, (rows, width)) * (rng.random((rows, width)) < 0.3)
            dense[:, columns:] = 0
            zero = rng.integers(1, 9, rows)
            r, c = np.nonzero(dense)
            forest = divergence.Forest(r, c, height, squares)
            sides.append((forest, np.append(dense[r, c][forest.order], 0), zero, np.where(dense > 0, dense, zero[:, None])))
        (fa, va, za, da), (fb, vb, zb, db) = sides
        want = np.abs(da[:, None, :] - db[None, :, :]).sum(2)
        assert (divergence.differences(fa, fb, va, vb, za, zb, squares) == want).all()
        own = np.triu(np.abs(da[:, None, :] - da[None, :, :]).sum(2), 1)
        assert (divergence.differences(fa, fa, va, va, za, za, squares) == own).all()


def test_shares_are_exact_beyond_64_bits():
    counts = [0, 1, 7, 10 ** 10, 3 * 10 ** 14]
    for total, terms in ((10 ** 15, 10 ** 6), (3 * 10 ** 14, 1), (12, 7)):
        some = [c for c in counts if c <= total]
        got = divergence.shares(np.array(some), np.full(len(some), total), terms)
        assert got.tolist() == [1 + 10 ** 9 * (c + 5) // (total + 5 * terms) for c in some]
