import os

from pricemill.schema import SUBMISSION_SCHEMA, TRAIN_SCHEMA
from pricemill.sources.csv import HEAD_BYTES, first_line, headers
from pricemill.sources.quarantine import read_csv_marked, read_csv_quarantined


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)


def marked(spark, folder, schema=SUBMISSION_SCHEMA, **how):
    rows = read_csv_marked(spark, str(folder), schema, **how).collect()
    return sorted((tuple(r)[:-3] + (r.record, r.reason, os.path.basename(r.file)) for r in rows), key=repr)


def test_bad_lines_stand_beside_the_good_ones(spark, tmp_path):
    write(tmp_path / "t", "a.csv", 'sample_id,price\n1,2.5\nx,3\n2\n3,4,5\n4,abc\n"5","6"\n7,inf\n8,\n,9\n12.5,1\n')
    write(tmp_path / "t", "b.csv", "sample_id,Price\n1,2\n2,x\n")
    write(tmp_path / "t", "c.csv", "")
    write(tmp_path / "t", "d.csv", "sample_id,price\n")
    for multi_line in (False, True):
        got = marked(spark, tmp_path / "t", multi_line=multi_line)
        assert got == sorted(
            [
                (1, 2.5, None, None, "a.csv"), (5, 6.0, None, None, "a.csv"), (7, float("inf"), None, None, "a.csv"),
                (8, None, None, None, "a.csv"), (None, 9.0, None, None, "a.csv"),
                (None, None, "x,3", "sample_id is no bigint: x", "a.csv"), (None, None, "2", "1 fields, not 2", "a.csv"),
                (None, None, "3,4,5", "3 fields, not 2", "a.csv"), (None, None, "4,abc", "price is no double: abc", "a.csv"),
                (None, None, "12.5,1", "sample_id is no bigint: 12.5", "a.csv"), (None, None, "sample_id,Price", "header", "b.csv"),
            ],
            key=repr,
        )


def test_prices_that_are_not_positive(spark, tmp_path):
    write(tmp_path / "t", "a.csv", "sample_id,price\n1,2.5\n2,-1\n3,0\n4,NaN\n5,\n6,inf\n")
    good, bad = read_csv_quarantined(spark, str(tmp_path / "t"), SUBMISSION_SCHEMA, positive=["price"])
    assert [tuple(r) for r in good.collect()] == [(1, 2.5)]
    rows = sorted(bad.collect(), key=lambda r: r.record)
    assert [r.record[0] for r in rows] == list("23456") and {r.reason for r in rows} == {"price is not positive"}


def test_texts_keep_their_newlines_and_quotes(spark, tmp_path):
    write(tmp_path / "t", "a.csv", 'sample_id,catalog_content,image_link,price\n1,"a, ""b""\nc",http://x,2\n2,"p,q",r,s,3\n3,NA,,4\n')
    got = marked(spark, tmp_path / "t", TRAIN_SCHEMA)
    assert got[:2] == [(1, 'a, "b"\nc', "http://x", 2.0, None, None, "a.csv"), (3, None, None, 4.0, None, None, "a.csv")]
    assert got[2][-3:] == ('2,"p,q",r,s,3', "5 fields, not 4", "a.csv")


def test_a_line_is_good_or_bad_whatever_is_selected(spark, tmp_path):
    write(tmp_path / "t", "a.csv", "sample_id,price\n1,2\nx,3\n4,5,6\n")
    good, bad = read_csv_quarantined(spark, str(tmp_path / "t"), SUBMISSION_SCHEMA, multi_line=False)
    assert [r.price for r in good.select("price").collect()] == [2.0]
    assert good.count() == 1 and bad.count() == 2 and bad.select("reason").distinct().count() == 2


class Counting:
    def __init__(self, data):
        self.data, self.asked = data, []

    def read(self, n):
        self.asked.append(n)
        part, self.data = self.data[:n], self.data[n:]
        return part


def test_a_header_costs_one_buffer():
    body = Counting(b"a,b\r\n" + b"1,2\n" * 1_000_000)
    assert first_line(body) == "a,b" and body.asked == [HEAD_BYTES]
    assert first_line(Counting(b"")) is None
    assert first_line(Counting(b"\n1,2")) == ""
    long = Counting(b"x" * (3 * HEAD_BYTES) + b"\nrest" + b"y" * 100_000)
    assert first_line(long) == "x" * (3 * HEAD_BYTES) and len(long.asked) == 4
    assert first_line(Counting(b"\xef\xbb\xbfa,b")) == "a,b"


def test_headers_read_the_start_of_files_alone(spark, tmp_path):
    import gzip

    write(tmp_path / "t", "a b.csv", "sample_id,price\n1,2\n")
    write(tmp_path / "t", "c.csv.gz", gzip.compress(b'"sample_id","price"\n1,2\n'))
    # A file of 64 GB that takes no room: a scan of its lines would not end.
    write(tmp_path / "t", "big.csv", "sample_id,prices\n1,2\n")
    os.truncate(tmp_path / "t" / "big.csv", 64 << 30)
    got = sorted((r.header, r.good) for r in headers(spark, str(tmp_path / "t"), SUBMISSION_SCHEMA).collect())
    assert got == [('"sample_id","price"', True), ("sample_id,price", True), ("sample_id,prices", False)]


def test_file_systems_that_only_spark_reads(spark, tmp_path, monkeypatch):
    from pricemill.sources import csv

    monkeypatch.setattr(csv, "_can_open", lambda path: False)
    write(tmp_path / "t", "a.csv", "sample_id,price\n1,2\n")
    write(tmp_path / "t", "b.csv", "sample_id,x\n1,2\n")
    got = sorted((r.header, r.good) for r in csv.headers(spark, str(tmp_path / "t"), SUBMISSION_SCHEMA).collect())
    assert got == [("sample_id,price", True), ("sample_id,x", False)]
