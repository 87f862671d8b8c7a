"""Secret scans over an incremental ledger of content-addressed blobs; DataFrame functions only."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.sources.staging import new_path


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if their group has ``least`` signs or more.

    Raise ``version`` with every change: the ledger scans known blobs again for a new version.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# Kinds, patterns and least lengths. A run of the last two kinds is a match from its first
# sign to its last, so their least length can stand in the pattern.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"
_SPANS = "array<struct<start:int,end:int>>"
# Matches whose places are summed in one go.
_RUN = 256
# Bits of one part of a bitmap, as ``bitmap_construct_agg`` makes them.
_BITS = 32768


def blob_of(text: Column) -> Column:
    """The content address of a text: sha256 of its UTF-8 bytes; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, rule: Rule) -> Column:
    """Column: the spans of a rule in a text, in code points.

    The pieces between matches and the matches themselves give the places by a running sum, taken over runs of
    ``_RUN`` matches and then inside them, so that the work grows with the number of matches.
    """
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), value.alias("value"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def runs_of(real):
        n_runs = F.ceil(F.size(real) / _RUN).cast("int")
        places = F.sequence(F.lit(0), F.greatest(n_runs - 1, F.lit(0)))
        return F.transform(places, lambda i: F.slice(real, i * _RUN + 1, _RUN))

    def length_of(run):
        return F.aggregate(run, F.lit(0), lambda sum_, p: sum_ + F.length(p["piece"]) + F.length(p["whole"]))

    def starts_of(runs):
        return F.aggregate(
            F.transform(runs, length_of),
            F.array(F.lit(0)),
            lambda starts, size: F.concat(starts, F.array(F.element_at(starts, -1) + size)),
        )

    def step(done, part):
        begin = done["at"] + F.length(part["piece"])
        end = begin + F.length(part["whole"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        span = F.when(F.length(part["value"]) >= rule.least, span).otherwise(none)
        return F.struct(end.alias("at"), F.concat(done["spans"], span).alias("spans"))

    def spans_of(runs, starts):
        return F.flatten(
            F.transform(
                F.arrays_zip(runs.alias("run"), F.slice(starts, 1, F.size(runs)).alias("at")),
                lambda r: F.aggregate(
                    r["run"], F.struct(r["at"].alias("at"), none.alias("spans")), step, lambda done: done["spans"]
                ),
            )
        )

    real = F.filter(parts, lambda p: p["whole"].isNotNull())
    spans = _once(_once(real, runs_of), lambda runs: _once(starts_of(runs), lambda starts: spans_of(runs, starts)))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _place(blob: Column) -> Column:
    """The first 28 bits of a content address."""
    return F.conv(F.substring(blob, 1, 7), 16, 10).cast("long")


def maybe_open(versions: DataFrame, open_blobs: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text) of the rows whose blob may be one of ``open_blobs``: all that are, and few others.

    The first 28 bits of the open blobs are a bitmap of 32 MB at most (8,192 parts of 4 kB), which is broadcast; where very
    many blobs are open it lets more rows pass, never fewer. Nothing is shuffled by text.
    """
    place = _place(F.col("blob"))
    bits = open_blobs.select(place.alias("_place"))
    bitmap = bits.groupBy(F.expr(f"_place div {_BITS}").alias("_part")).agg(
        F.bitmap_construct_agg(F.expr(f"_place % {_BITS}")).alias("_bitmap")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(blob_of(F.col(text_col)).alias("blob"), text.alias("text"))
    rows = rows.withColumn("_place", place).withColumn("_part", F.expr(f"_place div {_BITS}"))
    byte = F.expr(f"cast(conv(hex(substring(_bitmap, cast(_place % {_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
    met = rows.join(F.broadcast(bitmap), "_part").withColumn("_byte", byte)
    return met.filter("getbit(_byte, cast(_place % 8 as int)) = 1").select("blob", "text")


def scan_unseen(spark: SparkSession, versions: DataFrame, ledger: str, rules=RULES, text_col: str = "text") -> None:
    """Scan every blob of ``versions`` for every rule version that the ledger does not have, and add rows.

    The ledger is a Parquet folder with one row (blob, kind, version, spans) per blob and rule version. Of
    equal texts one is scanned; copies are one row per task before the shuffle by blob. Once the ledger holds
    rows, content addresses alone are compared with it first, and only texts that may be open are moved.
    """
    spark.range(0).selectExpr(*[f"cast(null as {t}) {n}" for n, t in (c.split(" ", 1) for c in LEDGER.split(", "))]).write.mode(
        "append"
    ).parquet(ledger)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    table = spark.read.schema(LEDGER).parquet(ledger)
    if table.isEmpty():
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        known = blobs.withColumn("open", wanted)
    else:
        seen = table.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        none = F.expr("cast(array() as array<struct<kind:string,version:int>>)")
        addresses = versions.select(blob_of(F.col(text_col)).alias("blob")).distinct().join(seen, "blob", "left")
        addresses = addresses.withColumn("open", F.array_except(wanted, F.coalesce("seen", none)))
        path = new_path(spark, "open-blobs")
        addresses.filter(F.size("open") > 0).select("blob", "open").write.parquet(path)
        open_blobs = spark.read.parquet(path)
        known = maybe_open(versions, open_blobs, text_col).dropDuplicates(["blob"]).join(open_blobs, "blob")
    found = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.when(
                    F.array_contains("open", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
                    matches(F.col("text"), r),
                ).alias("spans"),
            )
            for r in rules
        ]
    )
    rows = known.select("blob", F.explode(found).alias("f")).select("blob", "f.*")
    rows.filter(F.col("spans").isNotNull()).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, versions: DataFrame, ledger: str, rules=RULES, text_col: str = "text") -> DataFrame:
    """The columns of ``versions`` but the text, in a struct ``path``, with ``spans``: all findings of the
    blob at that path and version, as (start, rank of the rule, end, kind) in order of start and rank.

    Only blobs with findings are joined; a blob that very many paths share is split at run time.
    """
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ledger_rows = spark.read.schema(LEDGER).parquet(ledger)
    of_blob = (
        ledger_rows.filter(F.array_contains(current, F.struct("kind", "version")) & (F.size("spans") > 0))
        .select("blob", F.array_position(kinds, F.col("kind")).cast("int").alias("rank"), "kind", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", "rank", "s.end", "kind"))).alias("spans"))
    )
    others = [F.col(f"`{c}`") for c in versions.columns if c != text_col]
    paths = versions.select(F.struct(*others).alias("path"), blob_of(F.col(text_col)).alias("blob"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    return paths.join(of_blob, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def scanned(spark: SparkSession, versions: DataFrame, ledger: str, rules=RULES, text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``versions`` and return ``findings``. An empty table gives none."""
    scan_unseen(spark, versions, ledger, rules, text_col)
    return findings(spark, versions, ledger, rules, text_col)
