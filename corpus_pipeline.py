"""Five stages from raw documents to token files; each works on all that the stage before kept.

The result of a stage is written before the next stage is called, which then removes what the stages before it
staged: nothing of a finished stage stays.
"""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricemill.llm import decontamination, line_rules, mixing, simhash, tokens
from pricemill.sources.staging import new_path, remove, staged_in

# Folders of the stages that have been called: (place of the stage, folder).
_folders: list[tuple[int, str]] = []


def release(spark: SparkSession, before: int) -> None:
    """Remove what the stages before this place staged."""
    for place, folder in [f for f in _folders if f[0] < before]:
        remove(spark, folder)
        _folders.remove((place, folder))


def stage(place: int):
    def wrap(work):
        @wraps(work)
        def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, place)
            folder = new_path(spark, f"stage-{place}")
            _folders.append((place, folder))
            with staged_in(folder):
                return work(spark, docs, sf_dir)

        return called

    return wrap


@stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the rules or are depleted; cut boilerplate lines from the others."""
    return line_rules.cleaned(docs, near_copies=True)


@stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return simhash.deduplicated(docs)


@stage(3)
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark text covers; cut shorter passages of it from the others."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage(4)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that every source comes near its target."""
    return mixing.mix(docs)


@stage(5)
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids as Simple-8b blocks; one row per document, from the files."""
    path = new_path(spark, "corpus-tokens")
    # Workers that ran the stages before are large already.
    tokens.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=CACHE_PIECES)
    return tokens.read_token_digests(spark, path)


CACHE_PIECES = 50_000

STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
    ("tokens", token_output),
]

# The fingerprints, the mix order and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, work in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        work(spark, docs, sf_dir).write.parquet(path)
        if written:
            remove(spark, written)
        docs, written = spark.read.parquet(path), path
    # The last stage writes its files at once; its rows come from them.
    rows = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, written)
    return rows
