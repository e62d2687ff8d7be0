"""File sources and sinks.

Readers are thin choices of ``spark.read`` options; everything after the read
stays lazy.  Type inference for text files (pandas reads 'NA', 'null', ...
as missing and then types the column) is one aggregate over the string read:
each column gets the narrowest type that every non-missing value casts to.
Jobs that know their schema pass ``schema=`` and skip that pass.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import qcol, quote
from tabulon.operators.profile import wide_to_long
from tabulon.session import materialized

# The texts pandas reads as missing by default (read_csv na_values).
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# File categories and limits of the upload manifest.
DATA_EXTENSIONS = [".csv", ".json", ".xlsx", ".xls", ".parquet", ".tsv"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff"]
TEXT_EXTENSIONS = [".txt", ".md", ".log"]
MAX_FILE_BYTES = 100 * 1024 * 1024

READABLE = {".csv", ".tsv", ".txt", ".json", ".parquet"}


# ------------------------------------------------------------------ S1 dispatch
def load(spark: SparkSession, path: str, fmt: str | None = None,
         schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read ``path`` by its extension (or ``fmt``).

    .csv, .tsv, .txt (tab or pipe), .json, .parquet.  Excel is not supported
    (no Spark source; see README).  Unknown extension -> ValueError; missing
    path -> FileNotFoundError.
    """
    ext = ("." + fmt.lower().lstrip(".")) if fmt else os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in READABLE:
        raise ValueError(f"Unsupported file format: {ext or '(none)'}")
    try:
        if ext == ".csv":
            return read_csv(spark, path, schema=schema, **options)
        if ext == ".tsv":
            return read_csv(spark, path, sep="\t", schema=schema, **options)
        if ext == ".txt":
            return read_delimited_text(spark, path, schema=schema, **options)
        if ext == ".json":
            return read_json(spark, path, schema=schema, **options)
        return read_parquet(spark, path, **options)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise


# ------------------------------------------------------------------ S2-S4 text
def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", header: bool = True,
             schema: T.StructType | str | None = None, infer: bool = True,
             na_values: Sequence[str] = PANDAS_NA, **options) -> DataFrame:
    """Delimited text with a header row.

    Columns are read as text and the ``na_values`` become NULL.  With ``schema``
    they are cast to its types (a single pass); otherwise each column is
    typed by ``infer_types`` (one aggregate).
    """
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    nas = [F.lit(v) for v in na_values]
    raw = raw.withColumns({c: F.when(~F.trim(qcol(c)).isin(*nas), qcol(c))
                           for c in raw.columns}) if nas and raw.columns else raw
    if schema is not None:
        return _typed(raw, schema)
    return infer_types(raw) if infer else raw


def _typed(raw: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Text columns as the types of ``schema``, by position; a value that does not
    convert is missing."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    if len(fields) != len(raw.columns):
        raise ValueError(f"{len(raw.columns)} columns in the file, {len(fields)} in the schema")
    return raw.select(*[
        (qcol(c) if isinstance(f.dataType, T.StringType) else F.trim(qcol(c)).try_cast(f.dataType))
        .alias(f.name) for c, f in zip(raw.columns, fields)])


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest of bigint, double, boolean, date,
    timestamp that all its non-missing values cast to (else keep string)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    tests = {
        "bigint": lambda c: F.trim(c).try_cast("bigint"),
        "double": lambda c: F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
                                   F.trim(c).try_cast("double")),
        "boolean": lambda c: F.when(F.lower(F.trim(c)).isin("true", "false"),
                                    F.lower(F.trim(c)) == "true"),
        "date": lambda c: F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"),
                                 F.try_to_date(F.trim(c), "yyyy-MM-dd")),
        "timestamp": lambda c: F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d"),
                                      F.try_to_timestamp(F.trim(c))),
    }
    stats = {"n": F.count, **{t: (lambda fn: lambda v: F.count(fn(v)))(fn)
                              for t, fn in tests.items()}}
    facts = {r["column"]: r for r in wide_to_long(df, cols, stats,
                                                  value=lambda c: qcol(c)).collect()}
    exprs = {}
    for c in cols:
        n = facts[c]["n"] if c in facts else 0
        if n == 0:
            continue
        for t, fn in tests.items():
            if facts[c][t] == n:
                exprs[c] = fn(qcol(c))
                break
    return df.withColumns(exprs) if exprs else df


def read_delimited_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """.txt tables.  Every file is tab-separated if its header line (the first
    that is not blank) holds a tab, else pipe-separated if it holds a pipe, else
    comma-separated; files of several kinds are put together by column name."""
    line = F.col("value")
    sep = F.when(line.contains("\t"), "\t").when(line.contains("|"), "|").otherwise(",")
    headers = _text_lines(spark, path).groupBy("file").agg(F.min_by("value", F.struct("start", "at")).alias("value")) \
        .select("file", sep.alias("sep"))
    kinds = [r["sep"] for r in headers.select("sep").distinct().orderBy("sep").collect()]  # three at most
    if len(kinds) < 2:
        return read_csv(spark, path, sep=kinds[0] if kinds else ",", **options)
    schema, infer = options.pop("schema", None), options.pop("infer", True)
    parts = []
    for kind in kinds:  # only where kinds are mixed are file names needed
        names = [r["file"] for r in headers.where(F.col("sep") == kind).select("file").collect()]
        parts.append(read_csv(spark, names, sep=kind, infer=False, **options))
    text = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if schema is not None:
        return _typed(text, schema)
    return infer_types(text) if infer else text


def _text_lines(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """(value, file, start, at) of the lines that are not blank; ``start`` (of the
    split in its file) and ``at`` order the lines of a file."""
    lines = spark.read.options(**options).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")


# ------------------------------------------------------------------ S5, S6 JSON
_CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool | None = None, flatten_structs: bool = True,
              **options) -> DataFrame:
    """JSON lines, a JSON array of objects or one object, in any mixture of files.

    By default every line is parsed once as a variant and nothing is guessed from
    a prefix.  One pass over the text gives the types of all values and says
    whether any line is no object or array; a second one gives the rows.  Only if there is
    such a line is its file taken as one document, its lines put together again in
    tasks (a document must fit one value); a file that is neither raises
    ValueError.  ``options`` go to the text reader then.  ``multi_line`` chooses
    Spark's own reader, with one document a file or one a line.  Nested objects become
    ``a.b`` columns; a key with values of several types is read as text.
    """
    if multi_line is not None:
        reader = spark.read.option("multiLine", multi_line).options(**options)
        df = (reader.schema(schema) if schema is not None else reader).json(path)
        if _CORRUPT in df.columns and len(df.columns) == 1:
            raise ValueError(f"Not a JSON table: {path}")
        return flatten(df) if flatten_structs else df
    lines = _text_lines(spark, path, **options)
    value = _one_value("value")
    parsed = lines.select("file", "start", "at", "value", value.alias("v"))
    found, odd = _types_and_odd(parsed)
    if odd:
        parsed = _with_documents(parsed, path)
        found, _ = _types_and_odd(parsed)
    if schema is None:
        if found is None or not found.startswith("OBJECT<") or found == "OBJECT<>":
            raise ValueError(f"Not a JSON table: {path}")
        schema = _struct_type(found)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    kind = ddl if ddl.upper().startswith("STRUCT<") else f"STRUCT<{ddl}>"
    df = _elements(parsed).select(F.try_variant_get("v", "$", kind).alias("r")).select("r.*")
    return flatten(df) if flatten_structs else df


def _one_value(col: str):
    """A text that is one JSON object or array and nothing else as a variant, else
    null.  The parser ignores what follows a value, so the value is parsed inside brackets."""
    text = F.regexp_replace(col, r"^\s+|\s+$", "")
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    whole = F.try_parse_json(F.concat(F.lit("["), col, F.lit("]")))
    one = F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(ends.isin("{}", "[]") & one, F.try_variant_get(whole, "$[0]", "variant"))


def _elements(parsed: DataFrame) -> DataFrame:
    """(v) of every value; an array gives its elements."""
    many = F.try_variant_get("v", "$", "array<variant>")
    return parsed.select(F.explode(F.coalesce(many, F.array("v"))).alias("v"))


def _types_and_odd(parsed: DataFrame) -> tuple[str | None, int]:
    """The type of all values together, and the number of texts that are none."""
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = parsed.select(F.explode(F.when(F.col("v").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(many))
                         .alias("e"), F.col("v").isNull().alias("none"))
    row = each.agg(F.schema_of_variant_agg("e").alias("found"), F.count_if("none").alias("odd")).first()
    return row["found"], row["odd"]


def _with_documents(parsed: DataFrame, path: str) -> DataFrame:
    """``parsed`` with each file that has an odd line as one value.  File names stay
    in tasks; those of files that are no document either are told, five at most."""
    odd = materialized(parsed.where("v is null").select("file").distinct())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "value"))), lambda r: r["value"])
    whole = parsed.join(odd, "file", "left_semi").groupBy("file") \
        .agg(F.array_join(lines, "\n").alias("value"))
    whole = materialized(whole).select("file", _one_value("value").alias("v"))
    broken = [r["file"] for r in whole.where("v is null").select("file").limit(5).collect()]
    if broken:
        raise ValueError(f"Not a JSON table: {broken}")
    return parsed.join(odd, "file", "left_anti").select("file", "v").unionByName(whole)


def flat_columns(schema: T.StructType, sep: str = ".") -> list:
    """Column expressions that lift every leaf of nested structs to the top."""
    def walk(dtype: T.StructType, path: list[str]):
        for f in dtype.fields:
            p = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p)
            else:
                yield p
    cols = []
    for p in walk(schema, []):
        c = F.col(quote(p[0]))
        for part in p[1:]:
            c = c.getField(part)
        cols.append(c.alias(sep.join(p)))
    return cols


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns -> top-level ``parent<sep>child`` columns.

    Arrays and maps are kept as they are (pandas ``json_normalize`` keeps
    lists too).  A projection only.
    """
    return df.select(*flat_columns(df.schema, sep))


def parse_json_column(df: DataFrame, col: str, schema: T.StructType | str | None = None,
                      sep: str = ".") -> DataFrame:
    """A JSON text column -> flattened ``col.field`` columns.

    ``schema`` defaults to the union of the keys and types of all values (one
    aggregate over the column); text that is no JSON gives missing values.  A
    key with values of several types is read as text.
    """
    if schema is None:
        found = df.agg(F.schema_of_variant_agg(F.try_parse_json(qcol(col)))).first()[0]
        if found is None or not found.startswith("OBJECT<") or found == "OBJECT<>":
            return df
        schema = _struct_type(found)
    parsed = df.withColumn(col, F.from_json(qcol(col), schema))
    nested = T.StructType([parsed.schema[col]])
    return parsed.select(*[qcol(c) for c in df.columns if c != col],
                         *flat_columns(nested, sep))


def _struct_type(variant_schema: str) -> str:
    """The text of a variant's schema as a DDL type; names are quoted, so only
    the words outside back-quotes are types."""
    out = []
    for i, part in enumerate(variant_schema.split("`")):
        if i % 2 == 0:
            part = re.sub(r"\bOBJECT<", "STRUCT<", part)
            part = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", part)
            part = re.sub(r"\b(VARIANT|VOID)\b", "STRING", part)
            part = re.sub(r"\bSTRUCT<>", "MAP<STRING, STRING>", part)
        out.append(part)
    return "`".join(out)


# ------------------------------------------------------------------ S7 parquet
# The Hadoop S3A option and provider for public (unsigned) reads.
S3A_PROVIDER_OPTION = "fs.s3a.aws.credentials.provider"
S3A_ANONYMOUS_PROVIDER = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"


def object_path(bucket: str, key: str = "", scheme: str = "s3a") -> str:
    """``bucket`` + ``key`` -> ``s3a://bucket/key`` (a key may be a prefix or glob)."""
    return f"{scheme}://{bucket.strip('/')}/{key.lstrip('/')}"


def read_parquet(spark: SparkSession, path: str | Sequence[str],
                 base_path: str | None = None, anonymous: bool = False,
                 **options) -> DataFrame:
    """Parquet files, folders or globs; ``base_path`` keeps partition
    columns (``year=/court=/bench=``) when a sub-folder is read, so filters on
    them prune folders.  Object-store paths (``s3a://``) need the S3A
    connector on the cluster; ``anonymous`` reads a public bucket without
    credentials (a per-read Hadoop option, the session is not changed)."""
    reader = spark.read
    if anonymous:
        reader = reader.option(S3A_PROVIDER_OPTION, S3A_ANONYMOUS_PROVIDER)
    if base_path:
        reader = reader.option("basePath", base_path)
    for k, v in options.items():
        reader = reader.option(k, v)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.parquet(*paths)


# ------------------------------------------------------------------ S8 manifest
def file_manifest(spark: SparkSession, path: str, recursive: bool = True,
                  max_bytes: int = MAX_FILE_BYTES, listing: str = "source") -> DataFrame:
    """One row per file -- ``(path, name, extension, category, bytes,
    modified, within_limit, readable)``.  Contents are never read.

    ``listing="source"`` takes the files from Spark's ``binaryFile`` source (any store
    that Spark opens; the driver holds the file list, and empty files are passed over).  ``listing="tasks"`` lists
    folders in tasks, level by level, so that no file list reaches the driver;
    for stores that the tasks' own file system library opens (local or mounted
    folders, ``s3://``, ``gs://``, ``hdfs://``).
    """
    if listing == "tasks":
        files = list_files(spark, [path], recursive)
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
                 .load(path).select("path", F.col("length").alias("bytes"),
                                    F.col("modificationTime").alias("modified")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    cat = (F.when(ext.isin(*DATA_EXTENSIONS), "data")
           .when(ext.isin(*IMAGE_EXTENSIONS), "images")
           .when(ext.isin(*TEXT_EXTENSIONS), "text").otherwise("other"))
    return files.select("path", name.alias("name"), ext.alias("extension"), cat.alias("category"),
                        "bytes", "modified", (F.col("bytes") <= max_bytes).alias("within_limit"),
                        ext.isin(*sorted(READABLE)).alias("readable"))


LISTED = "path string, bytes long, modified timestamp, folder boolean"


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of every folder, hidden ones (Spark's rule: ``_`` and ``.``) left out."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            remote = re.match(r"(?!file:)[a-z0-9+.-]+://[^/]*", folder)
            if remote:  # the store's own path of a folder begins with its root
                store, root = pafs.FileSystem.from_uri(remote[0])
                root, before = root.rstrip("/"), remote[0]
                inner = root + folder[remote.end():]
            else:
                store, root, before = pafs.LocalFileSystem(), "", "file:"
                inner = re.sub(r"^file:(//)?", "", folder)
            found = [e for e in store.get_file_info(pafs.FileSelector(inner)) if e.base_name[:1] not in ("_", ".")]
            yield pa.RecordBatch.from_arrays([
                pa.array([before + e.path[len(root):] for e in found], pa.string()),
                pa.array([e.size for e in found], pa.int64()),
                pa.array([e.mtime_ns // 1000 for e in found], pa.timestamp("us", "UTC")),
                pa.array([e.type == pafs.FileType.Directory for e in found], pa.bool_())],
                ["path", "bytes", "modified", "folder"])


def list_files(spark: SparkSession, folders: Sequence[str], recursive: bool = True) -> DataFrame:
    """``(path, bytes, modified)`` of all files under ``folders``.  A level's
    folders are a table dealt over tasks, each of which lists its own; what they find
    is written to the shared checkpoint folder and gives the next level."""
    level = spark.createDataFrame([(f,) for f in folders], "path string")
    out = None
    while True:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = materialized(level.repartition(tasks, "path").mapInArrow(_listed, LISTED))
        files = found.where("not folder").drop("folder")
        out = files if out is None else out.union(files)
        level = found.where("folder").select("path")
        if not recursive or level.isEmpty():
            return out


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """S8 totals: ``(category, files, bytes)``."""
    return manifest.groupBy("category").agg(F.count(F.lit(1)).alias("files"),
                                            F.sum("bytes").alias("bytes"))


# ------------------------------------------------------------------ S9 many sources
def load_sources(spark: SparkSession, paths: Sequence[str],
                 threads: int = 8) -> tuple[dict[int, DataFrame], DataFrame]:
    """Read every source, keep going on errors.

    Returns the DataFrames by index and a status table ``(source, index,
    success, n_rows, n_cols, columns, error)``.  An empty source is a failure
    ("no data").  Up to ``threads`` sources are read at the same time, each with one
    ``count`` in a scheduler pool of its own (with fair scheduling, a
    large source does not hold up the others); the order of the result is that of
    ``paths``.
    """
    def read(i: int) -> tuple:
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"source-{i % max(1, threads)}")
            df = load(spark, paths[i])
            n = df.count()
            if n == 0 or not df.columns:
                return None, (paths[i], i, False, 0, 0, [], "No data found or empty table")
            return df, (paths[i], i, True, n, len(df.columns), list(df.columns), None)
        except Exception as e:  # noqa: BLE001 -- one bad source must not stop the others
            return None, (paths[i], i, False, 0, 0, [], f"{type(e).__name__}: {e}"[:500])

    schema = ("source string, index int, success boolean, n_rows long, n_cols int, "
              "columns array<string>, error string")
    with ThreadPoolExecutor(max(1, min(threads, len(paths)))) as pool:
        # each call carries the caller's session, job group and other local properties
        found = list(pool.map(lambda i: inheritable_thread_target(spark)(read)(i), range(len(paths))))
    return ({i: df for i, (df, _) in enumerate(found) if df is not None},
            spark.createDataFrame([row for _, row in found], schema))


# ------------------------------------------------------------------ S13 append
def append_tables(frames: Sequence[DataFrame], by_name: bool = False) -> DataFrame:
    """UNION ALL -- positional like INSERT ... SELECT, or by name."""
    if not frames:
        raise ValueError("nothing to append")
    if by_name:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return reduce(lambda a, b: a.union(b), frames)


def append_to_table(df: DataFrame, name_or_path: str, fmt: str = "parquet",
                    partition_by: Sequence[str] | None = None, batch: str | None = None) -> None:
    """S13 sink: create on first write, append afterwards.

    With ``batch`` (any text that names what is appended) the rows go to a folder of
    their own, ``batch=<text>``, and replace what an earlier write of the same batch left
    there: a repeat after a failure appends nothing twice.
    """
    parts = list(partition_by or [])
    if batch is None:
        w = df.write.mode("append").format(fmt)
    else:
        parts = ["batch", *parts]
        w = df.withColumn("batch", F.lit(batch)).write.mode("overwrite").format(fmt) \
            .option("partitionOverwriteMode", "dynamic")
    if parts:
        w = w.partitionBy(*parts)
    if "/" in name_or_path or ":" in name_or_path:
        w.save(name_or_path)
    elif batch is not None:
        raise ValueError("a batch is written to a folder")
    else:
        w.saveAsTable(name_or_path)


# ------------------------------------------------------------------ S14 head
def sample_head(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (a top-n sort: each
    task keeps n rows, the driver merges partitions x n)."""
    return df.orderBy(*[qcol(c) for c in order_by]).limit(n)


def sample_preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """``(sample_json, sample_size, total_size)`` in one row."""
    total = df.count()  # one number
    head = sample_head(df, order_by, n)
    return head.agg(F.to_json(F.collect_list(F.struct(*[qcol(c) for c in df.columns])))
                    .alias("sample_json"), F.count(F.lit(1)).alias("sample_size"),
                    F.lit(total).alias("total_size"))


# ------------------------------------------------------------------ S15, S16 sinks
def answers_json(answers: DataFrame, id_col: str, pos_col: str, answer_col: str,
                 keys: DataFrame | None = None) -> DataFrame:
    """Per request, the answers as a JSON array in position order, or,
    when ``keys`` ``(id, keys array<string>)`` is given, as a JSON object that
    maps the i-th key to the i-th answer (missing answers -> null)."""
    grouped = answers.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"),
                                                         F.col(answer_col).alias("a")))),
                    lambda s: s["a"]).alias("answers"))
    if keys is None:
        return grouped.select(id_col, F.to_json("answers").alias("json"))
    j = keys.join(grouped, id_col, "left")
    return j.select(id_col, F.to_json(F.map_from_arrays(
        F.col("keys"),
        F.transform(F.col("keys"), lambda k, i: F.get(F.coalesce(F.col("answers"),
                                                                 F.array().cast("array<string>")),
                                                      i)))).alias("json"))


def write_request_log(df: DataFrame, path: str, ts_col: str = "timestamp") -> None:
    """Append request records as JSON lines, one folder per day."""
    (df.withColumn("date", F.to_date(F.col(ts_col))).write.mode("append")
     .partitionBy("date").json(path))
