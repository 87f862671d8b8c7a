import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from pricemill.operators.quantiles import exact_quantiles, nth_values, ordered_bits

SPECIAL = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, math.nextafter(1.0, 2.0), -1.0]


def table(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)


def test_bits_order_like_the_values(spark):
    draw = random.Random(3)
    values = SPECIAL + [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(500)]
    values = [v for v in values if v == v]
    rows = table(spark, values).select("v", ordered_bits("v").alias("b")).collect()
    by_bits = [r.v for r in sorted(rows, key=lambda r: r.b)]
    assert by_bits == sorted(values)
    zeros = {r.b for r in rows if r.v == 0}
    assert len(zeros) == 1
    assert table(spark, [None]).select(ordered_bits("v").alias("b")).first().b is None


@pytest.mark.parametrize("parts", [1, 5])
def test_any_place_of_any_values(spark, parts):
    draw = random.Random(parts)
    spread = [struct.unpack("<d", draw.randbytes(8))[0] for _ in range(300)]
    near = [math.nextafter(100.0, 1000) if i % 2 else 100.0 for i in range(50)]
    values = [v for v in SPECIAL + spread + near + [7.25] * 200 if v == v]
    want = sorted(values)
    places = [0, 1, 5, len(want) // 2, len(want) // 2, len(want) - 2, len(want) - 1, *draw.sample(range(len(want)), 20)]
    mixed = table(spark, [*values, None, float("nan"), float("nan")], parts)
    assert nth_values(mixed, "v", places) == [want[i] for i in places]


def test_quantiles_of_hot_and_few_values(spark):
    assert exact_quantiles(table(spark, [3.0] * 1000 + [4.0]), "v", [0, 0.5, 0.999, 1]) == [3.0, 3.0, 3.0, 4.0]
    assert exact_quantiles(table(spark, [2.0, 1.0]), "v", [0, 0.5, 0.51, 1]) == [1.0, 1.0, 2.0, 2.0]
    assert exact_quantiles(table(spark, [None, float("nan")]), "v", [0.5]) == [None]
    assert exact_quantiles(table(spark, []), "v", [0.5, 1]) == [None, None]
    whole = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert exact_quantiles(whole, "v", [0.25, 0.75]) == [250.0, 750.0]


def test_wrong_places(spark):
    with pytest.raises(IndexError):
        nth_values(table(spark, [1.0]), "v", [1])
    with pytest.raises(ValueError):
        exact_quantiles(table(spark, [1.0]), "v", [1.5])


def test_nothing_is_sorted_or_staged(spark, tmp_path, monkeypatch):
    from pricemill.sources import staging

    monkeypatch.setattr(staging, "new_path", lambda *a: pytest.fail("a table was staged"))
    seen = []
    frame = type(table(spark, [1.0]))
    monkeypatch.setattr(frame, "repartitionByRange", lambda *a, **k: seen.append(a))
    assert nth_values(table(spark, [float(i) for i in range(100)]), "v", [42]) == [42.0]
    assert not seen
