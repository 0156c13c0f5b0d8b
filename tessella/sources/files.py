"""Readers and writers of the artifacts around the tables."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.scalars import strict_json

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("win", T.IntegerType()),
        T.StructField("doc", T.IntegerType()),
        T.StructField("ctxb", T.LongType()),
        T.StructField("blen", T.IntegerType()),
        T.StructField("tok", T.IntegerType()),
        T.StructField("nll", T.DoubleType()),
        T.StructField("grp", T.LongType()),
    ]
)
MANIFEST_SCHEMA = "doc_id bigint, rel string, start bigint, `end` bigint, date string, provenance_flag boolean"
#: Smaller files are no part of a corpus.
LEAST_BYTES = 64


def corpus_files(spark: SparkSession, root: str, endings: list[str], excluded: tuple[str, ...] = (".git",)) -> DataFrame:
    """UTF-8 files below a root: rel, text (with a final line feed), bytes. Others and those below LEAST_BYTES are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(endings) + "}").load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), "^/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    rows = raw.select(rel.alias("rel"), "content", "length").where(F.col("length") >= LEAST_BYTES)
    folders = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))) & F.is_valid_utf8(F.col("content").cast("string")))
    text = F.col("content").cast("string")
    full = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return rows.select("rel", full.alias("text")).withColumn("bytes", F.octet_length("text").cast("bigint"))


def token_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped CSV dumps with the cell name from the file name."""
    rows = spark.read.schema(TOKEN_SCHEMA).option("header", "true").option("enforceSchema", "false").csv(path)
    return rows.withColumn("cell_name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1))


def reconciled(dump: DataFrame, meta: DataFrame) -> DataFrame:
    """Per cell the rows and bytes against those its metadata promise; ``ok`` is false for any difference or a missing side."""
    have = dump.groupBy("cell_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("blen").alias("bytes"))
    both = have.join(meta.select("cell_name", "n_scored", "bytes_scored"), "cell_name", "full_outer")
    return both.withColumn("ok", F.coalesce((F.col("rows") == F.col("n_scored")) & (F.col("bytes") == F.col("bytes_scored")), F.lit(False)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST").json(path)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as strict JSON: path, sha256, text, error (null if the file is a proper object)."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for text in b.column(2).to_pylist():
                try:
                    strict_json(text)
                    errors.append(None)
                except ValueError as err:
                    errors.append(str(err)[:200])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.string())], names=[*b.schema.names, "error"])

    return rows.mapInArrow(run, "path string, sha256 string, text string, error string")


def tex_of(data: bytes) -> tuple[str | None, str | None]:
    """Text of a source archive and the reason if there is none.

    PDFs are refused; gzip is opened; of a tar the .tex members are joined in
    order of their names; text that isn't UTF-8 is read as Latin-1.
    """
    if data[:4] == b"%PDF":
        return None, "pdf"
    try:
        raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        if tarfile.is_tarfile(io.BytesIO(raw)):
            with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                parts = [tar.extractfile(m).read() for m in sorted(tar.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.endswith(".tex")]
        else:
            parts = [raw]
    except (OSError, EOFError, tarfile.TarError, zlib.error) as err:
        return None, type(err).__name__
    texts = []
    for part in parts:
        try:
            texts.append(part.decode())
        except UnicodeDecodeError:
            texts.append(part.decode("latin-1"))
    return ("\n".join(texts), None) if texts else (None, "no-tex")


def source_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives of a folder as text: path, text, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [tex_of(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, error string")


def reference_index(objects: DataFrame) -> DataFrame:
    """References of compact index files (version 5): module, name, defined_in, parent, line, column.

    ``objects`` has the file's JSON in ``text``. The keys of its references
    are JSON themselves; local variables are skipped.
    """
    schema = "version int, module string, references map<string, struct<usages: array<array<string>>>>"
    root = objects.select(F.from_json("text", schema).alias("j")).where("j.version = 5")
    entries = root.select("j.module", F.explode("j.references").alias("key", "info")).withColumn("k", F.from_json("key", "struct<c: struct<m: string, n: string>>"))
    uses = entries.where("k.c is not null").select("module", F.col("k.c.n").alias("name"), F.col("k.c.m").alias("defined_in"), F.explode("info.usages").alias("u"))
    return uses.select("module", "name", "defined_in", F.expr("try_element_at(u, 5)").alias("parent"), F.expr("try_cast(u[0] as int)").alias("line"), F.expr("try_cast(u[1] as int)").alias("column"))


def write_once(df: DataFrame, path: str) -> None:
    """A table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is wanted and not done; null keys are never done."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def completions(spark: SparkSession, path: str) -> DataFrame:
    """Completion envelopes, files of key and value lines parted by a tab: path, fields (map), error.

    An envelope of blank lines, a line without exactly one tab, an empty key
    and a key given twice are errors; fields are null then. A file without a
    byte has no row: the reader passes over it.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    lines = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: x != "")
    parts = F.transform("lines", lambda x: F.split(x, "\t"))
    keys = F.transform("parts", lambda p: p[0])
    bad = F.when(F.size("lines") == 0, "empty").when(F.exists("parts", lambda p: (F.size(p) != 2) | (p[0] == "")), "malformed").when(F.size(F.array_distinct("keys")) != F.size("keys"), "repeated-key")
    split = rows.withColumn("lines", lines).withColumn("parts", parts).withColumn("keys", keys).withColumn("error", bad)
    values = F.transform("parts", lambda p: p[1])
    return split.select("path", F.when(F.col("error").isNull(), F.map_from_arrays("keys", values)).alias("fields"), "error")


def token_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lists of a parser's tokens, one a line: path, tokens, error.

    Lines end with a line feed, the last one too, are not empty, strictly
    ascending by bytes and so without repeats; else ``error`` says why
    and tokens are null. A list is as long as a language has tokens. A file
    without a byte has no row.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    bad = (
        F.when(F.contains("text", F.lit("\r")), "carriage-return").when(~F.endswith("text", F.lit("\n")), "no-final-line-feed")
        .when(F.array_contains("lines", ""), "empty-line").when(F.size(F.array_distinct("lines")) != F.size("lines"), "repeated").when(F.array_sort("lines") != F.col("lines"), "unsorted")
    )
    return rows.withColumn("lines", lines).withColumn("error", bad).select("path", F.when(F.col("error").isNull(), F.col("lines")).alias("tokens"), "error")


def bindings(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, state`` of each wanted artifact: bound, missing, malformed, other-schema or other-hash.

    ``objects``: what ``json_objects`` gives; ``wanted``: name (the file's),
    schema, sha256. The schema is the object's own ``schema`` field.
    """
    have = objects.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("sha256").alias("h"), F.get_json_object("text", "$.schema").alias("s"), "error")
    j = wanted.join(have, "name", "left")
    state = (
        F.when(F.col("h").isNull(), "missing").when(F.col("error").isNotNull(), "malformed").when(~F.col("s").eqNullSafe(F.col("schema")), "other-schema").when(F.col("h") != F.col("sha256"), "other-hash").otherwise("bound")
    )
    return j.select("name", state.alias("state"))


def rehashed_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Each pair of a source and its index (rel, sha256, index_rel, index_sha256) with whether the files (rel, sha256) are still those: ``state``."""
    of = lambda a, b: files.select(F.col("rel").alias(a), F.col("sha256").alias(b))
    j = pairs.join(of("rel", "h1"), "rel", "left").join(of("index_rel", "h2"), "index_rel", "left")
    state = F.when(F.col("h1").isNull() | F.col("h2").isNull(), "missing").when(F.col("h1") != F.col("sha256"), "source-changed").when(F.col("h2") != F.col("index_sha256"), "index-changed").otherwise("paired")
    return j.select("rel", "index_rel", state.alias("state"))


def write_streams(files: DataFrame, path: str, stream: str, order: list[str], text: str = "text") -> None:
    """The texts of each stream laid end to end: a folder ``stream=...`` whose parts, in order of their names, are the stream.

    Range-partitioned by stream and order, so a stream of any size spreads
    over parts; a text without a final line feed gets one. Null texts are left
    out. The folder must not exist yet.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = F.regexp_replace(text, r"\n\z", "")  # the writer ends each row with a line feed
    rows = files.where(F.col(text).isNotNull()).repartitionByRange(parts, stream, *order).sortWithinPartitions(stream, *order)
    rows.select(F.col(stream).alias("stream"), bare.alias("value")).write.mode("errorifexists").partitionBy("stream").text(path)


def write_reports(df: DataFrame, path: str) -> None:
    """A report twice: flat columns as CSV with a header under ``csv``, everything as JSON lines under ``json``."""
    flat = [f.name for f in df.schema.fields if not f.dataType.typeName() in ("array", "map", "struct")]
    df.select(*flat).write.mode("errorifexists").option("header", "true").csv(f"{path}/csv")
    df.write.mode("errorifexists").json(f"{path}/json")
