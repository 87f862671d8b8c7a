"""Plans that must hold at any size: hot keys, no cross joins, no rows through one task."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pricemill.operators.images import image_manifest
from pricemill.operators.leaderboard import score_submissions
from pricemill.operators.scoring import error_metrics
from pricemill.operators.validation import check_submission
from pricemill.queries import QUERIES
from pricemill.sources import staging

ROWS = 300_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    changed = []

    def change(**values):
        for name, value in values.items():
            spark.conf.set(name.replace("__", "."), value)
            changed.append(name.replace("__", "."))

    yield change
    for name in changed:
        spark.conf.unset(name)


def hot_predictions(spark):
    """A third of all rows repeat one id, with different prices."""
    sample_id = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id"))
    return spark.range(0, ROWS, 1, 8).select(
        sample_id.alias("sample_id"), (F.col("id") % 977 + 1.0).alias("price")
    )


def truth(spark):
    return spark.range(0, ROWS, 1, 4).select(F.col("id").alias("sample_id"), F.lit(50.0).alias("price"))


def test_hot_id_is_counted_before_the_metric_shuffle(spark):
    got = error_metrics(hot_predictions(spark), truth(spark))
    row = got.first()
    assert (row.n_pairs, row.n_missing, row.n_extra, row.n_repeated) == (ROWS - ROWS // 3, ROWS // 3, 0, 1)
    assert row.smape is None
    plan = plan_of(got.select("*"))
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_hot_id_is_counted_before_the_shuffle(spark):
    row = check_submission(hot_predictions(spark), truth(spark)).first()
    thirds = ROWS // 3
    assert (row.n_got, row.missing, row.extra, row.dup_ids) == (ROWS, thirds, 0, 1)
    plan = plan_of(check_submission(hot_predictions(spark), truth(spark)))
    assert plan.count("hashpartitioning") == 1
    above, below = plan.split("Exchange hashpartitioning", 1)
    assert "partial_sum" in below and "Join" not in plan


def test_hot_id_is_grouped_before_the_leaderboard_join(spark):
    submissions = hot_predictions(spark).withColumn("submission_id", F.concat(F.lit("a"), F.col("price") * 0))
    scores = score_submissions(submissions, truth(spark), F.col("sample_id") < 1000)
    row = scores.first()
    assert (row.n_got, row.dup_ids, row.ok, row.final_smape) == (ROWS, 1, False, None)
    plan = plan_of(scores.select("*"))
    join = plan.index("Join")
    assert "hashpartitioning(submission_id" in plan[join:] and "partial_count" in plan[join:]


def test_manifest_counts_before_each_shuffle(spark):
    link = F.concat(F.lit("http://h/"), F.col("id") % 5, F.lit("/x.jpg"))
    manifest = image_manifest(spark.range(ROWS).select(link.alias("image_link")), "o")
    assert [tuple(r) for r in manifest.collect()] == [("x.jpg", "http://h/0/x.jpg", 5, "o/x.jpg")]
    plan = plan_of(manifest.select("*"))
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2
    assert len(re.findall("HashAggregate|ObjectHashAggregate|SortAggregate", plan)) == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows(spark, sf_dir, name, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def session_with(**settings):
    values = {name.replace("__", "."): value for name, value in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: values.get(name, default)))


def test_shared_folder_is_the_one_the_session_names():
    session = session_with(spark__master="yarn", spark__checkpoint__dir="hdfs:///shared/")
    assert staging.new_path(session, "x").startswith("hdfs:///shared/pricemill/x-")


def test_a_local_session_may_do_without():
    folder = staging.shared_folder(session_with(spark__master="local[2]"))
    assert folder == staging.shared_folder(session_with(spark__master="local[2]"))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(session_with(spark__master="yarn"))
