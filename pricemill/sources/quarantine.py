"""CSV reads that set bad lines aside instead of stopping at the first one."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.functions.errors import bad_price
from pricemill.functions.text import null_tokens_to_null
from pricemill.sources.csv import FORMAT, headers

_RECORD = "_bad_record"
QUARANTINE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("file", "record", "reason")])


def n_fields(record: Column) -> Column:
    """Fields of a line: the commas outside quotes, and one."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.regexp_replace(bare, ",", "")) + 1


def reason_of(record: Column, schema: T.StructType) -> Column:
    """Why a line does not parse: the number of its fields, else the first column whose text is no such value."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    fields = F.from_csv(record, texts.simpleString()[7:-1].replace(":", " "), {k: str(v) for k, v in FORMAT.items() if k != "header"})
    count = n_fields(record)
    expected = len(schema.fields)
    reason = F.when(count != expected, F.concat(count.cast("string"), F.lit(f" fields, not {expected}")))
    for field in schema.fields:
        if not isinstance(field.dataType, T.StringType):
            text = fields[field.name]
            wrong = text.isNotNull() & (text != "") & text.try_cast(field.dataType).isNull()
            reason = reason.when(wrong, F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text))
    return reason.otherwise("unreadable")


def read_csv_marked(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    pandas_nulls: bool = True,
    multi_line: bool = True,
    positive: Sequence[str] = (),
    from_folders: tuple[str, ...] = (),
) -> DataFrame:
    """Every line of headed CSV files: the columns of ``schema``, ``file``, ``record``, ``reason``.

    A good line has no ``record`` and no ``reason``. A line with too many or too few fields, or with text in
    a number column, has its own text as ``record``, the first fault as ``reason`` and null columns. A line
    whose value in a column of ``positive`` is not a positive finite number has its columns, as CSV, as
    ``record``. A file whose header differs in any letter is one row: its header, with reason 'header'; none
    of its lines is read as data, since their columns are unknown. Files without a line have no row.

    All columns are parsed for every job that looks at ``reason``, so a line is good or bad whatever a job
    selects. ``multi_line`` as in ``read_csv``: a quote that is never closed takes the rest of the file. The
    headers are read at once (see ``headers``), the lines when a job asks for them.
    """
    written = T.StructType([f for f in schema.fields if f.name not in from_folders])
    # At most one row per file, and the driver lists the files in any case.
    found = headers(spark, path, written).filter(~F.col("good")).select("file", "header").collect()
    wrong = spark.createDataFrame([(r.file, r.header, "header") for r in found], QUARANTINE_SCHEMA)
    rows = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())]))
        .options(**FORMAT)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .csv(path)
    )
    values = {}
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType):
            values[field.name] = null_tokens_to_null(F.col(field.name)) if pandas_nulls else F.nullif(F.col(field.name), F.lit(""))
        else:
            values[field.name] = F.col(field.name)
    bad_values = [(name, bad_price(name)) for name in positive]
    reason = F.when(F.col(_RECORD).isNotNull(), reason_of(F.col(_RECORD), written))
    for name, bad in bad_values:
        reason = reason.when(bad, F.lit(f"{name} is not positive"))
    # Never true, but it keeps all columns in the scan: the parser only notices what it converts.
    reason = reason.when(F.hash(*schema.names).bitwiseAND(F.lit(0)) != 0, F.lit("unreadable"))
    as_csv = F.to_csv(F.struct(*[F.col(f.name) for f in written.fields]), {"quote": '"', "escape": '"'})
    any_bad = reduce(lambda a, b: a | b, [bad for _, bad in bad_values], F.lit(False))
    record = F.when(F.col(_RECORD).isNotNull(), F.col(_RECORD)).when(any_bad, as_csv)
    marked = rows.select("*", F.col("_metadata.file_path").alias("file"), record.alias("record"), reason.alias("reason"))
    marked = marked.select(
        *[F.when(F.col("reason").isNull(), value).alias(name) for name, value in values.items()], "file", "record", "reason"
    )
    kept = marked.join(F.broadcast(wrong.select("file")), "file", "left_anti") if found else marked
    kept = kept.select(*schema.names, "file", "record", "reason")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return kept.unionByName(wrong.select(*nothing, "file", "record", "reason"))


def read_csv_quarantined(spark: SparkSession, path: str | list[str], schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the good lines under ``schema``, and ``file, record, reason`` of what was set aside.

    See ``read_csv_marked``. Both come from the same lazy read: write the marked table once where both are used.
    """
    marked = read_csv_marked(spark, path, schema, **options)
    good = marked.filter(F.col("reason").isNull()).select(*schema.names)
    return good, marked.filter(F.col("reason").isNotNull()).select(*QUARANTINE_SCHEMA.names)
