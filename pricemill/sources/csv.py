"""CSV tables that survive a round trip: fixed schemas, quoted newlines, doubled quotes, white space."""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.functions.text import null_tokens_to_null, number_text
from pricemill.schema import FETCH_THREADS, SUBMISSION_SCHEMA, TEST_SCHEMA, TRAIN_SCHEMA

# Reader and writer must agree on these, or text comes back changed.
FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "encoding": "UTF-8",
}

# Read from the start of each file for its header.
HEAD_BYTES = 4096
FILE_ORDER = ("source_file", "source_block", "source_row")


def first_line(stream) -> str | None:
    """The first line of a binary stream, without its end; None if there is none. Reads ``HEAD_BYTES`` at a time."""
    head = b""
    while b"\n" not in head:
        more = stream.read(HEAD_BYTES)
        if not more:
            break
        head += more
    line = head.split(b"\n", 1)[0]
    return line.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").rstrip("\r") if head else None


def _open(path: str):
    """A stream of a file by the path Spark gives it, unpacked by its ending."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, plain = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, plain = fs.FileSystem.from_uri(path)
    # Unbuffered: the stream reads what it is asked for.
    return system.open_input_stream(plain, compression="detect", buffer_size=None)


def _can_open(path: str) -> bool:
    try:
        _open(path).close()
    except Exception:  # no such file system here: Spark's own reader has to do
        return False
    return True


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def head(path):
        with _open(path) as stream:
            return first_line(stream)

    with ThreadPoolExecutor(FETCH_THREADS) as pool:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "header": list(pool.map(head, batch["path"]))})


def _scanned_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header) from a scan of all lines, for file systems that only Spark reads."""
    lines = spark.read.text(path)
    first = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )
    return first.filter("block = 0").groupBy("file").agg(F.min_by("line", "at").alias("header"))


def headers(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """(file, header, good): the first line of every file, and whether it names exactly these columns.

    Files without a line have no header and no row here; Spark reads them as no rows. Names may be quoted.
    A folder that holds no header at all cannot be read.

    Tasks open every file and read its first ``HEAD_BYTES`` (more only if the line is longer), whatever its size;
    packed files are unpacked as far as that. File systems that pyarrow cannot open are scanned by lines instead.
    """
    # The listing alone: the content column is not asked for, so no file is read here.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path")
    one = files.select("path").head()
    if one is None or _can_open(one.path):
        first = files.mapInPandas(_first_lines, "file string, header string").filter("header is not null")
    else:
        first = _scanned_headers(spark, path)
    names = F.transform(F.split("header", ","), lambda n: F.regexp_replace(n, '^"(.*)"$', "$1"))
    return first.withColumn("good", names == F.array(*[F.lit(n) for n in schema.names]))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    pandas_nulls: bool = True,
    multi_line: bool = True,
    file_order: bool = False,
    check_headers: bool = True,
    from_folders: tuple[str, ...] = (),
) -> DataFrame:
    """Headed CSV under a fixed schema; a wrong header or an unparseable value fails.

    The header of every file is compared letter by letter, from the first bytes of the file (see ``headers``);
    ``check_headers=False`` leaves that out, and Spark then compares the headers when the rows are read,
    without regard to case.

    ``pandas_nulls`` turns the null tokens of a pandas read into nulls in text columns; empty text is
    null either way. A file with quoted newlines cannot be split, so it is one task: give a large table
    as many files, or pass ``multi_line=False`` where no text holds a newline. ``file_order`` adds three
    columns (``FILE_ORDER``) that sort the rows as they stand in the files. ``from_folders`` names the
    columns of the schema that come from folder names and are in no header.

    Spark parses only the columns a job uses, so a job that skips a column does not check it.
    """
    if check_headers:
        written = T.StructType([f for f in schema.fields if f.name not in from_folders])
        wrong = F.min(F.when(~F.col("good"), F.struct("file", "header")))
        n_files, bad = headers(spark, path, written).agg(F.count("*"), wrong).first()
        if bad is not None or n_files == 0:
            found = f"the header of {bad.file} is {bad.header!r}" if n_files else "there is no header"
            raise ValueError(f"{found}, not {','.join(written.names)!r}")
    df = (
        spark.read.schema(schema)
        .options(**FORMAT)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .csv(path)
    )
    columns = []
    for field in schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            cleaned = null_tokens_to_null(column) if pandas_nulls else F.nullif(column, F.lit(""))
            column = cleaned.alias(field.name)
        columns.append(column)
    if file_order:
        # A task reads its blocks one after the other, so the id grows along every block.
        columns += [
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("source_block"),
            F.monotonically_increasing_id().alias("source_row"),
        ]
    return df.select(*columns)


def read_products(
    spark: SparkSession, path: str | list[str], priced: bool = False, **options
) -> DataFrame:
    """Product table: id, text, link, and the price if ``priced``."""
    return read_csv(spark, path, TRAIN_SCHEMA if priced else TEST_SCHEMA, **options)


def read_submission(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Two-column prediction table; any other header, and text in a number column, fails the job."""
    return read_csv(spark, path, SUBMISSION_SCHEMA, multi_line=False)


def csv_columns(df: DataFrame) -> DataFrame:
    """The table as it is printed: floating-point columns in Python's number format."""
    return df.select(
        *[
            number_text(F.col(f"`{f.name}`").cast("double")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def csv_writer(df: DataFrame, mode: str):
    return df.write.mode(mode).options(**FORMAT).option("emptyValue", "").option("nullValue", "")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headed CSV without an index column, in a folder that is created if need be."""
    csv_writer(csv_columns(df), mode).csv(path)
