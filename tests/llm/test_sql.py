"""The queries that SQL can express against their SQL twins."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle import connect, differences
from pricemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) == ""


def test_lines_over_the_limit_match_sql(spark, tmp_path):
    # Half of the texts of one host share a line; those of which it is over half are rejected. At another host
    # it stands in as many texts, which are under the share.
    rows = []
    for i in range(120):
        own = " ".join(f"w{i}x{j}" for j in range(60 if i % 2 else 20))
        rows.append((i, f"{own}\n{' '.join(f'menu{j}' for j in range(40))}", "big"))
        rows.append((1000 + i, f"{own}\nanother line {i}", "big"))
        rows.append((2000 + i, f"{own}\n{' '.join(f'menu{j}' for j in range(40))}", "huge"))
    rows += [(10_000 + i, f"text {i}\n" + " ".join(f"v{i}x{j}" for j in range(60)), "huge") for i in range(120 * 20)]
    rows += [(20_000 + i, f"line of ten\n" + " ".join(f"u{i}x{j}" for j in range(60)), None) for i in range(10)]
    rows += [(30_000 + i, f"line of eleven\n" + " ".join(f"t{i}x{j}" for j in range(60)), "") for i in range(11)]
    table = pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows)))))
    pq.write_table(table, tmp_path / "documents.parquet")
    query = QUERIES["op4_line_rules"](spark, str(tmp_path))
    assert differences(query, connect(tmp_path), ORACLE_SQL["op4_line_rules"]) == ""
    kept = {r.doc_id: r.kept for r in query.collect() if r.doc_id < 1000}
    assert kept == {i: i % 2 == 1 for i in range(120)}
    huge = {r.doc_id: r.kept for r in query.collect() if 2000 <= r.doc_id < 10_000}
    assert len(huge) == 120 and all(huge.values())
