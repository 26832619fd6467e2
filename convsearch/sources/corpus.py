"""Corpus sources and sinks: policy files on disk, placeholder rows for empty
domains, chunk/vector tables partitioned by domain."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import redact

DEFAULT_DOMAINS = C.DOMAINS


def read_corpus(spark: SparkSession, root: str, domains=DEFAULT_DOMAINS) -> DataFrame:
    """One row per ``<root>/<domain>/*.txt|*.md`` file (non-recursive, whole
    file, UTF-8) -> (domain, source, text). Unreadable files are skipped;
    a missing folder, local or remote, yields no rows."""
    folders = f"{root.rstrip('/')}/{{{','.join(domains)}}}"
    try:
        # wholetext must be text()'s argument: its default overrides .option()
        df = (spark.read.option("pathGlobFilter", "*.{txt,md}")
              .option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
              .text(folders, wholetext=True))
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "domain string, source string, text string")
    return df.select(file_domain().alias("domain"), file_source().alias("source"), F.col("value").alias("text"))


def file_source() -> Column:
    """The path of a read file, decoded, without the scheme of local files."""
    # a plus sign is not encoded in paths, but url_decode takes it for a space
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.regexp_replace(path, "^file:(//)?", "")


def file_domain() -> Column:
    """The name of the folder that a read file lies in."""
    return F.element_at(F.split(file_source(), "/"), -2)


def document_id(domain="domain", source="source") -> Column:
    """Id of a document that comes without one, the same in the build job and
    in every re-index. 43 bits, so that chunk ids fit a long."""
    return F.pmod(F.xxhash64(domain, source), F.lit(1 << 43))


def with_doc_id(docs: DataFrame) -> DataFrame:
    """``docs`` with their own ``doc_id``, or ``document_id`` without one."""
    return docs if "doc_id" in docs.columns else docs.withColumn("doc_id", document_id())


def domain_list(spark: SparkSession, domains) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def with_placeholder(docs: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains without documents get one placeholder row. Given document ids
    are kept; a placeholder's id is negative then, so that it meets none."""
    missing = domains.join(docs.select("domain").distinct(), "domain", "left_anti")
    ph = missing.select("domain", F.lit("placeholder").alias("source"),
                        F.concat(F.lit("No documents loaded for "), F.col("domain"), F.lit(".")).alias("text"))
    columns = ["domain", "source", "text"]
    if "doc_id" in docs.columns:
        columns.append("doc_id")
        ph = ph.withColumn("doc_id", -1 - document_id())
    return docs.select(*columns).unionByName(ph)


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, redact(text_col))


def write_partitioned(df: DataFrame, path: str, partition_cols=("domain",)) -> None:
    """Dynamic partition overwrite: only the domains present in ``df`` are
    replaced (re-indexing one domain leaves the others untouched)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def read_partitioned(spark: SparkSession, path: str, domains=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("domain").isin(list(domains))) if domains else df
