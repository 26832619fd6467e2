"""A persisted lexical index: built when a domain is missing, searched without
reading any text.

Layout below ``root`` (``v`` is the version a build made, one folder each):

* ``chunks/v=/domain=``           chunk_id, source, fp (first 100 characters), dl
* ``corpus/v=``                   domain, n, avgdl, avg_idf
* ``terms/v=/domain=``            bucket, term, df, idf, most, least
* ``postings/v=/domain=/bucket=`` term, chunk_id, tf, dl; files sorted by term
* ``champions/v=/domain=``        bucket, term, chunk_id, tf, dl: each term's heaviest
* ``manifest/<number>.json``      domain -> version, complete after each commit

A posting's weight, the BM25 weight of one occurrence of the term in a query, is
made by the search from the term's idf; so a build shuffles the postings once.
``most`` and ``least`` bound the weight for all chunks of the domain. A term's bucket is
its hash, so a search reads the buckets of its terms only.

A build writes all tables of its domains into a new version and commits them
by one new manifest; what it replaced stays readable until ``vacuum``. Nobody
reads a version without a manifest, so a build that fails leaves no trace but
its files. A manifest is put in place by a rename that fails if its number is
taken; then the commit is repeated on top of the other one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fingerprint, tokenize
from ..operators.lexical import idf_table, impact
from ..spark import cut_lineage, maybe_broadcast

SCHEMAS = {
    "chunks": "chunk_id long, source string, fp string, dl int, v string, domain string",
    "corpus": "domain string, n long, avgdl double, avg_idf double, v string",
    "terms": "bucket int, term string, df long, idf double, most double, least double, v string, domain string",
    "postings": "term string, chunk_id long, tf long, dl int, v string, domain string, bucket int",
    "champions": "bucket int, term string, chunk_id long, tf long, dl int, v string, domain string",
}
#: About so many postings of a bucket go to one task.
POSTINGS_PER_TASK = 2_000_000
#: So many tokens of a task's rows are counted at a time (one row at least).
TOKENS = 1_000_000


class LexicalStore:
    """The index below ``root``, a folder that the whole cluster shares. Each
    term's ``champions`` heaviest postings are kept apart, for thresholds."""

    schemas = SCHEMAS

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, champions: int = 32):
        self.spark, self.root, self.buckets, self.champions = spark, root.rstrip("/"), buckets, champions

    # ---------------------------------------------------------------- files
    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _last(self) -> int:
        return max((int(n[:-5]) for n in self._names("manifest") if n.endswith(".json")), default=0)

    def live(self) -> dict[str, str]:
        """domain -> version of the last commit."""
        return {d: v for d, v in self._state().items() if not d.startswith("/")}

    def _state(self) -> dict:
        """All that the last commit holds: versions of domains, and marks,
        whose names begin with a slash."""
        if not (n := self._last()):
            return {}
        fs, p = self._at(f"{self.root}/manifest/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: str, domains: Iterable[str], gone: Iterable[str] = (), marks: dict | None = None) -> None:
        """From now on ``version`` is read for ``domains``, and none for those
        that are ``gone``; ``marks`` are kept beside them, in the same commit."""
        domains, gone = list(domains), set(gone)
        jvm = self.spark._jvm
        while True:
            n = self._last() + 1
            text = json.dumps({d: v for d, v in {**self._state(), **dict.fromkeys(domains, version), **(marks or {})}.items() if d not in gone})
            fs, draft = self._at(f"{self.root}/manifest/.{uuid.uuid4().hex}")
            out = fs.create(draft)
            out.write(bytearray(text.encode()))
            out.close()
            _, place = self._at(f"{self.root}/manifest/{n:012d}.json")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
            plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(draft, place, plain)
                return
            except Exception as taken:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(taken):
                    raise

    def vacuum(self) -> list[str]:
        """Delete the versions that the last manifest does not name; not to be
        run beside a build or a search that began before the last commit."""
        live, old = set(self.live().values()), set()
        for table in self.schemas:
            for name in self._names(table):
                if name.startswith("v=") and name[2:] not in live:
                    fs, p = self._at(f"{self.root}/{table}/{name}")
                    fs.delete(p, True)
                    old.add(name[2:])
        return sorted(old)

    # ---------------------------------------------------------------- tables
    def _read(self, table: str, versions: Iterable[str]) -> DataFrame:
        base = f"{self.root}/{table}"
        return self.spark.read.schema(self.schemas[table]).option("basePath", base).parquet(*[f"{base}/v={v}" for v in sorted(set(versions))])

    def table(self, name: str, domains: Iterable[str] | None = None) -> DataFrame:
        """The live rows of a table; only folders of live versions (and, if
        given, of ``domains``) are read."""
        live = self.live()
        wanted = {d: v for d, v in live.items() if domains is None or d in set(domains)}
        if not wanted:
            return self.spark.createDataFrame([], self.schemas[name]).drop("v")
        by: dict[str, list[str]] = {}
        for d, v in wanted.items():
            by.setdefault(v, []).append(d)
        here = F.lit(False)
        for v, names in by.items():
            here |= (F.col("v") == v) & F.col("domain").isin(names)
        return self._read(name, by).filter(here).drop("v")

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    # ---------------------------------------------------------------- build
    def build(self, chunks: DataFrame, text_col: str = "content", domains: Iterable[str] | None = None) -> str:
        """Index ``chunks`` (domain, chunk_id, source, text) anew and commit:
        all domains that they hold, and of ``domains`` those without a chunk as
        empty."""
        v = uuid.uuid4().hex
        held = self.write(chunks, v, text_col)
        self.commit(v, held, [d for d in list(domains or []) if d not in held and d in self.live()])
        return v

    def write(self, chunks: DataFrame, v: str, text_col: str = "content") -> list[str]:
        """Write the index of ``chunks`` as version ``v``, which nobody reads
        before a commit; the domains that they hold. The texts are read twice,
        for the lengths and for the postings."""
        out = lambda t: f"{self.root}/{t}/v={v}"
        chunks = chunks.filter("domain is not null")
        (chunks.select("domain", F.col("chunk_id").cast("long").alias("chunk_id"), "source", fingerprint(text_col, 100).alias("fp"),
                       F.coalesce(F.size(tokenize(text_col)), F.lit(0)).alias("dl"))
         .write.partitionBy("domain").parquet(out("chunks")))
        own = self._read("chunks", [v]).drop("v")
        corpus = own.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.greatest("dl", F.lit(0))).cast("double") / F.count(F.lit(1))).alias("avgdl"))

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(out(name))
            return self.spark.read.schema(df.schema).parquet(out(name))

        tf = term_counts(chunks.select("domain", F.col("chunk_id").cast("long").alias("chunk_id"), tokenize(text_col).alias("toks")), own)
        words = own.agg(F.sum(F.col("dl").cast("long"))).first()[0] or 0
        parts = 1 + words // (self.buckets * POSTINGS_PER_TASK)  # splits a bucket, however hot
        (tf.withColumn("bucket", self.bucket(F.col("term"))).repartition("domain", "bucket", F.pmod(F.col("chunk_id"), F.lit(parts)))
         .sortWithinPartitions("domain", "bucket", "term", "chunk_id").write.partitionBy("domain", "bucket").parquet(out("postings")))
        # the weight for an idf of 1; what it is for the term's idf is bounded by both ends
        unit = impact(F.col("tf"), F.col("dl"), F.lit(1.0), F.col("avgdl"))
        postings = (self._read("postings", [v]).drop("v").join(F.broadcast(corpus.select("domain", "avgdl")), "domain")
                    .withColumn("unit", unit).drop("avgdl"))
        seen = kept(postings.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("df"), F.max("unit").alias("high"), F.min("unit").alias("low")), "frequencies")
        stats, avg_idf = idf_table(seen.select("domain", "term", "df"), corpus, C.BM25_EPSILON)
        corpus.join(avg_idf, "domain", "left").write.parquet(out("corpus"))
        stats = kept(stats, "idf")
        high, low = F.col("idf") * F.col("high"), F.col("idf") * F.col("low")
        (stats.join(seen.select("domain", "term", "high", "low"), ["domain", "term"])
         .select("domain", self.bucket(F.col("term")).alias("bucket"), "term", "df", "idf", F.greatest(high, low).alias("most"), F.least(high, low).alias("least"))
         .write.partitionBy("domain").parquet(out("terms")))
        # few terms have no positive idf; their heaviest are those of the least unit, or any
        turned = maybe_broadcast(stats.filter("idf <= 0").select("domain", "term", F.signum("idf").alias("sign")))
        heavy = F.coalesce("sign", F.lit(1.0)) * F.col("unit")
        best = Window.partitionBy("domain", "term").orderBy(F.desc("heavy"), "chunk_id")
        (postings.join(turned, ["domain", "term"], "left").withColumn("heavy", heavy)
         .withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= self.champions)
         .select("domain", "bucket", "term", "chunk_id", "tf", "dl").write.partitionBy("domain").parquet(out("champions")))
        for name in ("frequencies", "idf"):
            fs, p = self._at(out(name))
            fs.delete(p, True)
        return [r.domain for r in own.select("domain").distinct().collect()]  # one row a domain

    def ensure(self, domains: Iterable[str], load: Callable[[list[str]], DataFrame], text_col: str = "content") -> list[str]:
        """Build those of ``domains`` that are missing, from the chunks that
        ``load`` gives for them; the names of those that were."""
        live = self.live()
        missing = sorted({d for d in domains if d is not None and d not in live})
        if missing:
            self.build(load(missing), text_col, missing)
        return missing


def _counted(batches):
    """(domain, chunk_id, toks) -> (domain, chunk_id, term, tf, dl): the counts
    of each row's distinct terms, so many rows at a time as hold ``TOKENS``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        length = np.nan_to_num(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        piece = np.maximum(np.cumsum(length) - 1, 0) // TOKENS
        for at in np.unique(piece):
            first, end = np.searchsorted(piece, at), np.searchsorted(piece, at, "right")
            rows = batch.slice(first, end - first)
            toks = rows.column(2)
            coded = pc.list_flatten(toks).dictionary_encode()
            if not len(coded):
                continue
            many = len(coded.dictionary)
            keys, tf = np.unique(pc.list_parent_indices(toks).to_numpy().astype(np.int64) * many + coded.indices.to_numpy(), return_counts=True)
            row, term = pa.array(keys // many), pa.array(keys % many)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(row), rows.column(1).take(row), coded.dictionary.take(term), pa.array(tf.astype(np.int64)),
                 pa.array(length[first:end][keys // many].astype(np.int32))], names=["domain", "chunk_id", "term", "tf", "dl"])


def term_counts(toks: DataFrame, own: DataFrame) -> DataFrame:
    """(domain, chunk_id, toks) -> (domain, chunk_id, term, tf, dl). Each row is
    counted where it is; only rows of chunk ids that come more than once (by
    ``own``, the written chunks) are added up by a shuffle, ``dl`` is then the
    longest row's."""
    counted = toks.mapInArrow(_counted, "domain string, chunk_id long, term string, tf long, dl int")
    again = cut_lineage(own.groupBy("domain", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select(F.col("domain").alias("_d"), F.col("chunk_id").alias("_c")))
    if not again.limit(1).count():
        return counted
    again = maybe_broadcast(again)
    same = (F.col("domain") == F.col("_d")) & F.col("chunk_id").eqNullSafe(F.col("_c"))
    added = (counted.join(again, same, "left_semi").groupBy("domain", "chunk_id", "term")
             .agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl")))
    return counted.join(again, same, "left_anti").unionByName(added)


def input_version(spark: SparkSession, path: str) -> str:
    """A name for the present state of a dataset: of its files, their sizes
    and times."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("x"),
                    F.sum(F.col("file_size").cast("decimal(38,0)")).alias("size")).first()
    return f"{one.n}-{one.size or 0}-{(one.x or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
