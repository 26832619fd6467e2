"""N-gram Jaccard join: documents whose 5-word shingle sets are similar.

Method: multiple-global-order filtering. Under any total order of all shingles,
two sets of Jaccard similarity t or more share a shingle among the first
``n - ceil(t * n) + 1`` of each (the prefix). Candidates are pairs that share
prefix shingles under a first order, as many as their sizes ask for; they must
also share one under each of two further orders, and only those that pass every
filter are verified exactly. Whole sets are made for such documents only.

* The first order puts frequent shingles last (heavy ones counted over all
  documents with a lossy count), then goes by hash; the further orders go by
  other hashes. Which shingles count as heavy changes the cost, never the
  result.
* Copies with equal sets (by 128-bit fingerprint) are one class, whatever their
  doc_id; only classes are compared, under 64 bits of the fingerprint as their id.
* A shingle in one document only makes no candidate and goes at once.
* Groups of near copies are never expanded into all pairs. First every document
  is compared with two hubs of its groups; connected components of the links so
  far are formed; a round with other hubs joins more components; at last every
  remaining pair of a group whose two sides are in different components is
  compared. Pairs inside a component cannot change the result, so it is exact.

Words are runs of characters other than space and U+0009-U+000D after
lower-casing A-Z. Shingles are compared by 64-bit hash.

Defined cases: null, empty or blank text has an empty set, links with nothing
and is its own component; fewer words than a shingle make one shingle of the
whole sequence; equal texts share a component; of ties the smallest doc_id
names the component; extra columns are ignored; an empty table gives no rows.
Every row is a document: rows with a null or a repeated doc_id are compared by
their own text and each gives a row; nulls name a component (or class) only if
all of its doc_ids are null, and its id is null then."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored

WORDS, PERCENT = 5, 80
#: At most so many heavy shingles are put last in the first order.
HEAVY = 200_000
#: A shingle is heavy in a batch of documents from this share (and four).
HEAVY_SHARE = 0.0005
#: Bits of the bitmap that keeps texts of other documents out of the shuffle.
MARKS = 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix (two multiply-shift rounds) of ``x``."""
    x = x ^ np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of ``text``."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _ODD + h[j:len(words) - size + 1 + j]
    return np.unique(_mixed(out))


def prefix_length(n, percent: int = PERCENT):
    return n - (n * percent + 99) // 100 + 1


def _sets(batches, k):
    """The set of the text (first column) of each row, batch by batch."""
    for batch in batches:
        yield [shingle_set(t.as_py(), k) for t in batch.column(0)]


def class_id(fp: bytes, salt: int) -> int:
    """The 64-bit id of a class of equal sets, by its fingerprint."""
    low, high = int.from_bytes(fp[:8], "little"), int.from_bytes(fp[8:], "little")
    return ((low ^ high << salt & 0xFFFFFFFFFFFFFFFF if salt else low) ^ 1 << 63) - (1 << 63)


def _table(schema: list[tuple[str, object]], *cols):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


def profile(docs: DataFrame, k: int = WORDS, salt: int = 0) -> DataFrame:
    """Rows of two kinds: a document's id, hash of the text, set size, 128-bit
    fingerprint and class, or (shingle not null) a shingle frequent in a batch
    with its count there."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        schema = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("id", pa.int64()), ("shingle", pa.int64())]
        for batch in batches:
            sets = next(_sets([batch], k))
            n = [len(s) for s in sets]
            fp = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            ids = [None if f is None else class_id(f, salt) for f in fp]
            seen, count = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            often = count >= max(4, int(len(sets) * HEAVY_SHARE))
            heavy, own = seen[often].view(np.int64).tolist(), [None] * int(often.sum())
            yield _table(schema, batch.column(1).to_pylist() + own, batch.column(2).to_pylist() + own, n + count[often].tolist(), fp + own, ids + own, [None] * len(sets) + heavy)

    return docs.select("text", "doc_id", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n long, fp binary, id long, shingle long")


def first_prefixes(docs: DataFrame, heavy: np.ndarray, level: np.ndarray, k: int, percent: int, salt: int = 0) -> DataFrame:
    """(token, id, n, pos): the prefix of each class under the first order.
    Of copies within a task only the first is given."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        schema, seen = [("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())], set()
        for sets in _sets(batches, k):
            tokens, ids, sizes, places = [], [], [], []
            for s in sets:
                if not len(s) or (fp := xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(fp)
                n, p = len(s), prefix_length(len(s), percent)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    s = s[np.argsort(np.where(heavy[at] == s, level[at], 0), kind="stable")]
                tokens.append(s[:p])
                ids.append(np.full(p, class_id(fp, salt)))
                sizes.append(np.full(p, n))
                places.append(np.arange(p))
            if tokens:
                yield _table(schema, np.concatenate(tokens).view(np.int64), np.concatenate(ids), np.concatenate(sizes), np.concatenate(places))

    return docs.select("text").mapInArrow(run, "token long, id long, n int, pos int")


def _may_meet(percent: int) -> Column:
    """Whether a token can be the first that a and b share: the sizes fit, and
    what follows it in either set is enough. Every similar pair meets this at
    its first common token, whatever other tokens it shares."""
    na, nb = F.col("n_a"), F.col("n_b")
    need = (percent * (na + nb) + 99 + percent) / (100 + percent)
    rest = F.least(na - F.col("pos_a"), nb - F.col("pos_b"))
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & (rest >= F.floor(need))


def passes(a: np.ndarray, b: np.ndarray, percent: int, orders=(1, 2)) -> bool:
    """Whether two sets share a prefix element under each further order."""
    for seed in orders:
        p, q = (np.sort(_mixed(s, seed))[:prefix_length(len(s), percent)] for s in (a, b))
        if not len(np.intersect1d(p, q, assume_unique=True)):
            return False
    return True


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that pass the filters of the further orders
    and whose sets are similar."""
    def run(batches):
        import pyarrow as pa

        schema = [("a", pa.int64()), ("b", pa.int64())]
        for batch in batches:
            a, b, sa, sb = (batch.column(c) for c in ("a", "b", "sa", "sb"))
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
                if passes(x, y, percent):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield _table(schema, a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64())))

    of = lambda side: sets.select(F.col("id").alias(side), F.col("elements").alias(f"s{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links``
    (a, b). In each round every node is hooked to its smallest neighbour, the
    trees that result are flattened by doubling, and the links between trees
    become the graph of the next round, until none is left. A tree that takes in
    no other one in a round meets a smaller one in the next, so two rounds halve
    the trees at least. Raises if ``max_rounds`` do not suffice."""
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")]))
    both, trees = stored(links.select(ends.alias("e")).select("e.a", "e.b"), "links"), []
    while not trees or both.limit(1).count():
        if len(trees) == max_rounds:
            raise RuntimeError(f"components: links between trees are left after {max_rounds} rounds")
        trees.append(_flat(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), max_rounds))
        top = lambda side: trees[-1].select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        both = stored(both.join(top("a"), "a").join(top("b"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
    labels = trees.pop()
    while trees:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = stored(trees.pop().join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")
    return labels


def _flat(hooks: DataFrame, max_rounds: int) -> DataFrame:
    """``hooks`` (id, component: its parent, a root's own id) with the root of
    each node as its component; the depth halves in every step."""
    tree = stored(hooks, "labels")
    for _ in range(max_rounds):
        up = tree.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = stored(tree.join(up, "component").select("id", F.col("component").alias("old"), F.col("far").alias("component")), "labels")
        tree = moved.select("id", "component")
        if moved.filter("old <> component").limit(1).count() == 0:
            return tree
    raise RuntimeError(f"components: trees are not flat after {max_rounds} steps")


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further ``links``: only the components
    that the links touch are joined, as the nodes of a smaller graph."""
    if labels is None:
        return components(links)
    top = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(top("a"), "a", "left").join(top("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
    up = components(ends)
    known = labels.unionByName(up.select("id", F.col("id").alias("component")).join(labels, "id", "left_anti"))
    up = up.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return stored(known.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")


def _element_table(docs: DataFrame, classes: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """(id, elements): the set of each of ``classes`` (text_hash and doc_id of a
    member)."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        schema, seen = [("id", pa.int64()), ("elements", pa.binary())], set()
        for sets in _sets(batches, k):
            new = {i: s.tobytes() for s in sets if len(s) and (i := class_id(xxh3_128_digest(s.tobytes()), salt)) not in seen}
            seen.update(new)
            yield _table(schema, list(new), list(new.values()))

    # copies of one text, from several tasks, give the same bytes. An inner
    # join: Catalyst would move a semi-join below that with the bitmap
    docs = _marked(docs, classes)
    here = (docs["text_hash"] == classes["text_hash"]) & docs["doc_id"].eqNullSafe(classes["doc_id"])
    sets = docs.join(classes.distinct(), here).select("text").mapInArrow(run, "id long, elements binary")
    return sets.groupBy("id").agg(F.first("elements").alias("elements"))


def _marked(docs: DataFrame, wanted: DataFrame, bits: int = MARKS) -> DataFrame:
    """The rows of ``docs`` whose text_hash may be in ``wanted``: all that are,
    and few others while ``wanted`` is small against ``bits``. The bitmap goes
    out as one row for each 64 bits that hold a mark, ``bits`` / 64 at most."""
    slot = F.col("text_hash").bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(slot, 6)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.select(word.alias("word"), mark.alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    may = docs.withColumn("word", word).join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(mark) != 0)
    return may.select(*docs.columns)


def candidates(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that the first order does not rule out: what
    two sets share outside their prefixes is at most the longer rest, so their
    prefixes must share all that the threshold asks for beyond it."""
    of = lambda side: shared.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("tokens").alias(f"t{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    rest = F.greatest(F.col("na") - prefix_length_of(F.col("na"), percent), F.col("nb") - prefix_length_of(F.col("nb"), percent))
    return both.filter(F.size(F.array_intersect("ta", "tb")) >= need - rest).select("a", "b")


def prefix_length_of(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def _hashed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and a hash of the text, which tells the rows of equal or
    null doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *extra)


def similar_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, class_id (first copy with an equal set) and
    component_id of every row."""
    return _similar_rows(docs, k, percent, rounds).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def _similar_rows(docs: DataFrame, k: int, percent: int, rounds: int = 2) -> DataFrame:
    """doc_id, text_hash, n, component (null for an empty set), component_id and
    class_id of every row. ``component`` is unique, the two ids are doc_ids."""
    docs = _hashed(docs)
    for salt in range(64):
        prof = stored(profile(docs, k, salt), "profile")
        own = prof.filter("shingle is null").select("doc_id", "text_hash", "n", "fp", "id")
        classes = stored(own.filter("fp is not null").groupBy("id").agg(
            F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min(F.struct("text_hash", "doc_id")).alias("member"), F.min("doc_id").alias("class_id")), "classes")
        if not classes.filter("fp <> other").limit(1).count():
            break
    else:
        raise RuntimeError("different sets share their 64-bit ids")

    often = (prof.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "shingle").limit(HEAVY).toPandas())
    heavy = often["shingle"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(heavy)
    level = np.frexp(often["n"].to_numpy(np.float64))[1].astype(np.int64)[at]
    raw = first_prefixes(docs, heavy[at], level, k, percent, salt).filter("token is not null and id is not null").repartition("token")
    # same columns and filters in both branches, so that they share the exchange
    shared = raw.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("most")).filter("lo <> hi and most > 0").select("token")
    postings = stored(raw.join(shared, "token").select("token", "id", "n", "pos").distinct(), "postings")

    shared = stored(postings.groupBy("id").agg(F.first("n").alias("n"), F.collect_set("token").alias("tokens")), "shared")

    done = labels = sets = None
    for turn in range(rounds + 1):
        rows = postings
        if labels is not None:
            rows = postings.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
            rows = rows.join(mixed.select("token", "lo"), "token")
        if turn < rounds:
            pairs = _hub_pairs(rows, labels is not None)
        else:
            left, right = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "component")]) for s in "ab")
            pairs = left.join(right, "token").filter("id_a < id_b and component_a <> component_b")
        pairs = pairs.filter(_may_meet(percent)).select(
            F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
        near = candidates(pairs, shared, percent)
        near = stored(near if done is None else near.join(done, ["a", "b"], "left_anti"), "candidates")
        done = near if done is None else done.unionByName(near)
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = ids if sets is None else ids.join(sets, "id", "left_anti")
        wanted = stored(classes.join(ids, "id", "left_semi").select("member.text_hash", "member.doc_id"), "wanted")
        new = stored(_element_table(docs, wanted, k, salt), "sets")
        sets = new if sets is None else sets.unionByName(new)
        labels = joined_components(labels, stored(verified(near, sets, percent), "verified"))

    top = classes.join(labels, "id", "left").select("id", "class_id", F.coalesce("component", "id").alias("component"))
    names = top.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return own.join(top.join(names, "component"), "id", "left").select(
        "doc_id", "text_hash", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _hub_pairs(rows: DataFrame, labelled: bool) -> DataFrame:
    """(id, n, pos of a and b): two hubs of each token's group with the others
    or, once there are components, two members of the largest component with two
    members of each other one. Of the two, one is taken by hash and one is that
    which may share most."""
    def order(*by):
        return F.struct(*[c.alias(f"by{i}") for i, c in enumerate(by)], "id", "n", "pos")

    # hubs of single documents by the id only: the same ones lead most groups
    chance = F.xxhash64("token", "id") if labelled else F.xxhash64("id")
    picks = [F.min(order(chance)).alias("x"), F.min(order(F.col("pos"), chance)).alias("y")]
    if labelled:
        rows = rows.groupBy("token", "component").agg(*picks, F.count("*").alias("many"))
        hubs = rows.groupBy("token").agg(F.max(F.struct("many", "component", "x", "y")).alias("h")).select("token", "h.x", "h.y")
    else:
        hubs = rows.groupBy("token").agg(*picks)
    sides = lambda df, s: df.select("token", F.explode(F.array(*[F.struct(F.lit(c).alias("pick"), *[F.col(f"{c}.{f}").alias(f"{f}_{s}") for f in ("id", "n", "pos")]) for c in "xy"])).alias("m")).select("token", "m.*")
    if labelled:
        pairs = sides(rows, "b").join(sides(hubs, "a"), ["token", "pick"])
    else:
        others = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "pos")])
        pairs = others.join(sides(hubs, "a"), "token")
    return pairs.filter("id_a <> id_b")


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of every component only: that of the smallest
    doc_id (nulls last), then of the smallest hash of the text; of rows equal in
    both, the first by their other columns. Rows with an empty set all stay."""
    rows = _similar_rows(docs, k, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = (rows.filter("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("many"))
            .groupBy("component").agg(F.min(F.struct(place.alias("place"), "many")).alias("best")).select("component", "best.place.*", "best.many"))
    best = checkpoint(best.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "many")
                      .unionByName(rows.filter("component is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(1).cast("long").alias("many")).distinct()))
    here = (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    single = docs.join(best.filter("many = 1"), here, "left_semi")
    repeats = best.filter("many > 1")
    if not repeats.limit(1).count():
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(repeats, here).groupBy("_id", "_hash").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return single.unionByName(again.select("row.*"))
