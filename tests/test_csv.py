import glob
import random

import pandas as pd
import pytest

from pyspark.sql.types import StructType

from pricemill.operators.chunking import read_indexed_csv, row_index
from pricemill.schema import NULL_TOKENS, TRAIN_SCHEMA
from pricemill.sources.csv import FILE_ORDER, read_csv, read_products, read_submission, write_csv

TEXTS = [
    "plain",
    "  leading and trailing  ",
    "ends with newline\n",
    "\n",
    "\r",
    "a\r\nb",
    "tab\tin",
    '"',
    'say ""twice""',
    "one, two",
    'C:\\x\\"q',
    "back\\slash\\",
    "line one\nline two\n\nline four",
    "'single'",
    "#comment",
    "é ü 漢字 🙂",
    "NA ",
    " NA",
    "0.5",
    ",",
    '",",',
    "\t",
]


def product_rows(texts):
    return [(i, t, f"http://h/{i}.jpg" if i % 3 else None, 1.5 + i) for i, t in enumerate(texts)]


def by_id(df):
    return [tuple(r) for r in df.orderBy("sample_id").collect()]


def single_file(path):
    (name,) = glob.glob(f"{path}/part-*.csv")
    return name


def test_edge_texts_survive(spark, tmp_path):
    rows = product_rows(TEXTS)
    write_csv(spark.createDataFrame(rows, TRAIN_SCHEMA), f"{tmp_path}/t")
    assert by_id(read_products(spark, f"{tmp_path}/t", priced=True)) == rows


def test_empty_text_and_null_tokens_become_null(spark, tmp_path):
    rows = product_rows(["", None, *NULL_TOKENS])
    write_csv(spark.createDataFrame(rows, TRAIN_SCHEMA), f"{tmp_path}/t")
    pandas_like = by_id(read_products(spark, f"{tmp_path}/t", priced=True))
    assert [r[1] for r in pandas_like] == [None] * len(rows)
    literal = by_id(read_products(spark, f"{tmp_path}/t", priced=True, pandas_nulls=False))
    assert [r[1] for r in literal] == [None, None, *[t or None for t in NULL_TOKENS]]


def test_reads_what_pandas_writes(spark, tmp_path):
    rows = product_rows([*TEXTS, *NULL_TOKENS])
    frame = pd.DataFrame(rows, columns=["sample_id", "catalog_content", "image_link", "price"])
    path = f"{tmp_path}/t.csv"
    frame.to_csv(path, index=False)
    back = pd.read_csv(path)
    back = back.astype(object).where(back.notna(), None)
    expected = [tuple(r) for r in back.itertuples(index=False)]
    assert by_id(read_products(spark, path, priced=True)) == expected


def test_pandas_reads_what_we_write(spark, tmp_path):
    rows = product_rows(TEXTS)
    write_csv(spark.createDataFrame(rows, TRAIN_SCHEMA).coalesce(1), f"{tmp_path}/t")
    frame = pd.read_csv(single_file(f"{tmp_path}/t"), lineterminator="\n")
    assert list(frame["catalog_content"]) == TEXTS
    assert list(frame["price"]) == [r[3] for r in rows]


def test_submission_file_is_byte_identical_after_a_round_trip(spark, tmp_path):
    rng = random.Random(1)
    ids = rng.sample(range(10_000, 300_000), 100)
    lines = [f"{i},{rng.uniform(0.5, 100)!r}" for i in ids] + ["7,20000000.0", "8,0.0005", "9,1e-05"]
    path = f"{tmp_path}/in.csv"
    text = "\n".join(["sample_id,price", *lines]) + "\n"
    with open(path, "w") as out:
        out.write(text)
    write_csv(read_submission(spark, path), f"{tmp_path}/out")
    with open(single_file(f"{tmp_path}/out")) as back:
        assert back.read() == text


@pytest.mark.parametrize(
    "text",
    [
        "id,price\n1,2.0\n",
        "price,sample_id\n1,2.0\n",
        "sample_id,price,extra\n1,2.0,3\n",
        "sample_id\n1\n",
        "Sample_Id,PRICE\n1,2.0\n",
        "sample_id, price\n1,2.0\n",
        "sample_id,sample_id\n1,2\n",
        "1,2.0\n",
        "",
        "sample_id,price\n1,cheap\n",
        "sample_id,price\n1,NA\n",
        "sample_id,price\nx,2.0\n",
        "sample_id,price\n1,2.0,3\n",
        "sample_id,price\n1\n",
    ],
)
def test_malformed_submission_fails(spark, tmp_path, text):
    path = f"{tmp_path}/bad.csv"
    with open(path, "w") as out:
        out.write(text)
    with pytest.raises(Exception, match="(?i)header|malformed|FAILED_READ_FILE"):
        read_submission(spark, path).collect()


def test_wrong_header_in_a_later_file_fails(spark, tmp_path):
    for name, header in (("a", "sample_id,price"), ("b", "sample_id,cost")):
        with open(f"{tmp_path}/{name}.csv", "w") as out:
            out.write(f"{header}\n1,2.0\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_submission(spark, str(tmp_path)).collect()


def test_odd_prices_are_read_not_dropped(spark, tmp_path):
    path = f"{tmp_path}/odd.csv"
    with open(path, "w") as out:
        out.write("sample_id,price\n1,\n2,NaN\n3,inf\n4,-inf\n5,1e-05\n")
    got = {r.sample_id: r.price for r in read_submission(spark, path).collect()}
    assert got[1] is None and got[2] != got[2]
    assert (got[3], got[4], got[5]) == (float("inf"), float("-inf"), 1e-5)


def test_empty_table_still_has_a_header(spark, tmp_path):
    write_csv(spark.createDataFrame([], TRAIN_SCHEMA), f"{tmp_path}/t")
    with open(single_file(f"{tmp_path}/t")) as back:
        assert back.read() == "sample_id,catalog_content,image_link,price\n"
    assert read_products(spark, f"{tmp_path}/t", priced=True).count() == 0


def test_existing_output_is_kept_unless_asked(spark, tmp_path):
    table = spark.createDataFrame(product_rows(["a"]), TRAIN_SCHEMA)
    write_csv(table, f"{tmp_path}/deep/t")
    with pytest.raises(Exception, match="(?i)already exists"):
        write_csv(table, f"{tmp_path}/deep/t")
    write_csv(table.limit(0), f"{tmp_path}/deep/t", mode="overwrite")
    assert read_products(spark, f"{tmp_path}/deep/t", priced=True).count() == 0


@pytest.fixture(params=["whole files", "files in blocks"])
def ordered_files(spark, tmp_path, request):
    """Three files read one task per file, or cut into many blocks; and the ids in file order."""
    rng = random.Random(3)
    expected = []
    for name in ("a", "b", "c"):
        ids = rng.sample(range(10**6), 700)
        expected += ids
        pd.DataFrame({"sample_id": ids, "price": [1.0] * 700}).to_csv(
            f"{tmp_path}/{name}.csv", index=False
        )
    blocks = request.param == "files in blocks"
    if blocks:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    schema = StructType.fromDDL("sample_id bigint, price double")
    yield {"path": str(tmp_path), "schema": schema, "multi_line": not blocks}, expected
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_order(spark, ordered_files):
    how, expected = ordered_files
    indexed = row_index(read_csv(spark, **how, file_order=True), list(FILE_ORDER))
    assert [r.sample_id for r in indexed.orderBy("idx").collect()] == expected


def test_indexed_csv(spark, ordered_files):
    how, expected = ordered_files
    indexed = read_indexed_csv(spark, **how)
    assert indexed.columns == ["sample_id", "price", "idx"]
    got = indexed.orderBy("idx").collect()
    assert [r.sample_id for r in got] == expected and [r.idx for r in got] == list(range(2100))
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_a_filter_comes_after_the_index(spark, ordered_files):
    how, expected = ordered_files
    late = read_indexed_csv(spark, **how).filter("sample_id % 2 = 0").orderBy("idx").collect()
    assert [(r.idx, r.sample_id) for r in late] == [(i, s) for i, s in enumerate(expected) if s % 2 == 0]


@pytest.mark.parametrize("threshold", ["-1", "1g"])
def test_written_rows_are_never_shuffled_again(spark, ordered_files, threshold):
    how, _ = ordered_files
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for indexed in (read_indexed_csv(spark, **how), row_index(spark.range(1000), "id", 300)):
            plan = indexed._jdf.queryExecution().executedPlan().toString()
            rows = plan.split("BroadcastExchange")[0]
            assert "BroadcastHashJoin" in rows and "Exchange hashpartitioning" not in rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_in_file_names_count_as_numbers(spark, tmp_path):
    names = ["part-99999", "part-100000", "part-9", "train2", "train10", "train010b", "x1y10", "x1y9"]
    for i, name in enumerate(names):
        (tmp_path / f"{name}.csv").write_text(f"sample_id,price\n{i},1.0\n")
    got = read_indexed_csv(spark, str(tmp_path), StructType.fromDDL("sample_id bigint, price double"))
    order = [names[r.sample_id] for r in got.orderBy("idx").collect()]
    assert order == ["part-9", "part-99999", "part-100000", "train2", "train10", "train010b", "x1y9", "x1y10"]


def test_indexed_csv_of_no_rows(spark, tmp_path):
    write_csv(spark.createDataFrame([], TRAIN_SCHEMA), f"{tmp_path}/t")
    assert read_indexed_csv(spark, f"{tmp_path}/t", TRAIN_SCHEMA).collect() == []


@pytest.mark.parametrize("header", ["SAMPLE_ID,Price", "sample_id", "sample_id,price,note", "price,sample_id"])
def test_every_header_is_compared_letter_by_letter(spark, tmp_path, header):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text(f"sample_id,price\n{i},1.0\n")
    (tmp_path / "2.csv").write_text(header + "\n1,1.0\n")
    schema = StructType.fromDDL("sample_id bigint, price double")
    with pytest.raises(ValueError, match="2.csv"):
        read_csv(spark, str(tmp_path), schema)
    (tmp_path / "2.csv").write_text('"sample_id","price"\r\n1,1.0\r\n')
    assert read_csv(spark, str(tmp_path), schema).count() == 4


def test_unused_columns_are_not_parsed(spark, tmp_path):
    write_csv(spark.createDataFrame(product_rows(["a"]), TRAIN_SCHEMA), f"{tmp_path}/t")
    plan = read_products(spark, f"{tmp_path}/t", priced=True).select("sample_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sample_id:bigint>" in text


def test_random_texts_survive(spark, tmp_path):
    rng = random.Random(11)
    alphabet = ['"', "'", ",", "\n", "\r", "\r\n", " ", "\t", "\\", "a", "é", "漢", "🙂", ";", "#", "0", "NA"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(3000)]
    texts = [t for t in texts if t not in NULL_TOKENS]
    rows = product_rows(texts)
    write_csv(spark.createDataFrame(rows, TRAIN_SCHEMA).repartition(5), f"{tmp_path}/t")
    assert by_id(read_products(spark, f"{tmp_path}/t", priced=True)) == rows
