import os
import time

import pytest
from pyspark.sql import functions as F

from pricemill.operators.images import ArrowStore, FolderStore, fetch_images, image_manifest, pending_images
from pricemill.plans import fetch
from pricemill.queries import QUERIES
from pricemill.sources import staging
from pricemill.sources.files import list_files


def links(spark, values):
    return spark.createDataFrame([(v,) for v in values], "image_link string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_manifest(spark):
    values = ["http://h/b/x.jpg", "http://h/a/x.jpg", "http://h/a/x.jpg", None, "", "/", "http://h/..", "y"]
    got = rows(image_manifest(links(spark, values), "out/"))
    assert got == [("x.jpg", "http://h/a/x.jpg", 2, "out/x.jpg"), ("y", "y", 1, "out/y")]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_manifest_with_a_hot_name_on_any_partitioning(spark, parts):
    link = F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://h/"), "id", F.lit("/main.jpg")))
    link = F.coalesce(link, F.concat(F.lit("http://h/i/"), F.col("id") % 50, F.lit(".jpg")))
    table = spark.range(3000).repartition(parts).select(link.alias("image_link"))
    got = {r[0]: r for r in rows(image_manifest(table, "o"))}
    assert len(got) == 51
    assert got["main.jpg"][1:3] == ("http://h/0/main.jpg", 1000)
    assert got["7.jpg"] == ("7.jpg", "http://h/i/7.jpg", 1, "o/7.jpg")


def test_collisions_in_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("image_link"))
    manifest = image_manifest(pages, "out")
    assert (manifest.count(), manifest.filter("n_urls = 2").count()) == (242, 8)
    present = manifest.filter(F.substring(F.md5("filename"), 1, 1) < "8").select("filename")
    assert pending_images(manifest, present).count() == 118


def test_failed_files_stay_pending(spark):
    manifest = image_manifest(links(spark, ["h/a", "h/b", "h/c"]), "o")
    status = [("a", "ok"), ("a", "error"), ("b", "error")]
    done = spark.createDataFrame(status, "filename string, status string")
    assert [r[0] for r in rows(pending_images(manifest, done))] == ["b", "c"]
    listed = done.select("filename")
    assert [r[0] for r in rows(pending_images(manifest, listed))] == ["c"]


def make_fetcher(folder, failing=()):
    """Fake fetcher that leaves one file per call."""

    def fetcher(url):
        name = url.rsplit("/", 1)[1]
        with open(f"{folder}/{name}.{os.urandom(8).hex()}", "w"):
            pass
        if name in failing:
            raise OSError("throttled")
        return b"x" * len(url)

    return fetcher


def calls(folder):
    return sorted(name.rsplit(".", 1)[0] for name in os.listdir(folder))


def test_fetch_and_retry(spark, tmp_path):
    log, images, status = (str(tmp_path / n) for n in ("log", "images", "status"))
    os.mkdir(log)
    table = links(spark, [f"http://h/{n}" for n in "abcdef"] + ["http://h/a", None])
    first = fetch(table, images, status, make_fetcher(log, failing="cd"), n_tasks=3)
    assert rows(first) == [("error", 2), ("ok", 4)]
    assert calls(log) == list("abcdef")
    assert sorted(os.listdir(images)) == list("abef")
    errors = spark.read.parquet(status).filter("status = 'error'").collect()
    assert {(r.filename, r.n_bytes, r.error) for r in errors} == {
        ("c", None, "OSError: throttled"), ("d", None, "OSError: throttled"),
    }
    second = fetch(table, images, status, make_fetcher(log), n_tasks=3)
    assert rows(second) == [("ok", 6)]
    assert calls(log) == sorted("abcdef" + "cd")
    fetch(table, images, status, make_fetcher(log), n_tasks=3)
    assert len(calls(log)) == 8
    assert rows(list_files(spark, images).select("filename", "n_bytes")) == [(n, 10) for n in "abcdef"]


def test_repeated_run_does_not_fetch_present_files(spark, tmp_path):
    log, images = str(tmp_path / "log"), str(tmp_path / "images")
    os.mkdir(log)
    table = fetch_images(image_manifest(links(spark, ["h/a", "h/b"]), images), make_fetcher(log), n_tasks=2)
    expected = [("a", "h/a", f"{images}/a", "ok", 3, None), ("b", "h/b", f"{images}/b", "ok", 3, None)]
    assert rows(table) == expected and rows(table) == expected
    assert calls(log) == ["a", "b"]


def test_names_that_cannot_be_written_are_errors(spark, tmp_path):
    log, images = str(tmp_path / "log"), str(tmp_path / "images")
    os.mkdir(log)
    table = links(spark, ["h/ok", "h/" + "n" * 300])
    got = fetch_images(image_manifest(table, images), lambda url: b"1", n_tasks=1)
    assert sorted(r.status for r in got.collect()) == ["error", "ok"]


@pytest.mark.parametrize("threads", [1, 20])
def test_links_of_one_task_are_fetched_together(spark, tmp_path, threads):
    def slow(url):
        start = time.monotonic()
        time.sleep(0.1)
        return f"{start} {time.monotonic()}".encode()

    images = str(tmp_path / "images")
    table = links(spark, [f"h/{i}" for i in range(20)])
    got = fetch_images(image_manifest(table, images), slow, n_tasks=1, threads=threads)
    assert {r.status for r in got.collect()} == {"ok"}
    spans = [tuple(map(float, (tmp_path / "images" / n).read_text().split())) for n in os.listdir(images)]
    together = max(sum(a <= start < b for a, b in spans) for start, _ in spans)
    assert together == 1 if threads == 1 else together > 5


def test_nothing_pending(spark, tmp_path):
    empty = fetch_images(image_manifest(links(spark, [None]), "o"), lambda url: b"", n_tasks=2)
    assert empty.collect() == []


def test_failed_write_leaves_no_file(tmp_path):
    store = FolderStore()
    with pytest.raises(TypeError):
        store.save(str(tmp_path / "a"), "not bytes")
    assert os.listdir(tmp_path) == [] and store.size(str(tmp_path / "a")) is None
    store.save(str(tmp_path / "new" / "a"), b"12")
    assert store.size(str(tmp_path / "new" / "a")) == 2 and os.listdir(tmp_path / "new") == ["a"]


def test_list_files(spark, tmp_path):
    names = ["a b.jpg", "a+b.jpg", "a%20b.jpg", "b.jpg?x=1", "25#top", "é.jpg"]
    for name in [*names, "_skipped", ".hidden"]:
        (tmp_path / name).write_bytes(b"123")
    got = rows(list_files(spark, str(tmp_path)).select("filename", "n_bytes"))
    assert got == sorted((n, 3) for n in names)
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    (tmp_path / "empty").mkdir()
    assert list_files(spark, str(tmp_path / "empty")).isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_files(spark, str(tmp_path / "missing")).count()


def test_another_folder_and_a_deleted_file_are_fetched(spark, tmp_path):
    log, images, status = (str(tmp_path / n) for n in ("log", "images", "status"))
    os.mkdir(log)
    table = links(spark, ["http://h/a", "http://h/b"])
    fetch(table, images, status, make_fetcher(log), n_tasks=2)
    assert rows(fetch(table, images + "2", status, make_fetcher(log), n_tasks=2)) == [("ok", 2)]
    assert sorted(os.listdir(images + "2")) == ["a", "b"] and calls(log) == ["a", "a", "b", "b"]
    os.unlink(f"{images}/a")
    assert rows(fetch(table, images, status, make_fetcher(log, failing="a"), n_tasks=2)) == [("error", 1), ("ok", 1)]
    assert rows(fetch(table, images, status, make_fetcher(log), n_tasks=2)) == [("ok", 2)]
    assert sorted(os.listdir(images)) == ["a", "b"]
    os.unlink(f"{images}/b")
    trusting = fetch(table, images, status, make_fetcher(log), n_tasks=2, trust_log=True)
    assert rows(trusting) == [("ok", 2)] and os.listdir(images) == ["a"]


@pytest.mark.parametrize("folder", ["hdfs://nn/images", "s3://bucket/x", "file:/tmp/x"])
def test_a_plain_folder_has_no_scheme(spark, folder):
    got = fetch_images(image_manifest(links(spark, ["h/a"]), folder), lambda url: b"1", FolderStore(), n_tasks=1)
    assert [(r.status, "ArrowStore" in r.error) for r in got.collect()] == [("error", True)]
    assert not os.path.exists("hdfs:") and not os.path.exists("s3:") and not os.path.exists("file:")


def test_a_cluster_needs_a_shared_store(spark):
    manifest = image_manifest(links(spark, ["h/a"]), "o")
    master = spark.conf.get("spark.master")
    try:
        spark.conf.set("spark.master", "yarn")
    except Exception:
        pytest.skip("the master cannot be changed here")
    try:
        with pytest.raises(ValueError, match="ArrowStore"):
            fetch_images(manifest, lambda url: b"1")
        fetch_images(manifest, lambda url: b"1", FolderStore(shared=True))
    finally:
        spark.conf.set("spark.master", master)


def test_store_by_scheme(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    folder = f"file://{tmp_path}/images"
    table = links(spark, ["http://h/a", "http://h/b"])
    assert rows(fetch(table, folder, str(tmp_path / "status"), make_fetcher(log), n_tasks=2)) == [("ok", 2)]
    assert sorted(os.listdir(tmp_path / "images")) == ["a", "b"] and calls(log) == ["a", "b"]
    store = ArrowStore()
    assert store.size(f"{folder}/a") == 10 and store.size(f"{folder}/none") is None
    with pytest.raises(TypeError):
        store.save(f"{folder}/c", 1)
    assert sorted(os.listdir(tmp_path / "images")) == ["a", "b"]


def test_names_with_signs_of_a_link_are_files_of_their_own(spark, tmp_path):
    names = ["a", "a?x=1", "a?x=22", "a#top", "a b", "a%20b", "é"]
    table = links(spark, [f"http://h/{n}" for n in names])
    got = fetch_images(image_manifest(table, f"file://{tmp_path}/images"), lambda url: url.encode(), ArrowStore(), n_tasks=2)
    assert sorted((r.filename, r.status, r.n_bytes) for r in got.collect()) == sorted((n, "ok", len(f"http://h/{n}".encode())) for n in names)
    assert sorted(os.listdir(tmp_path / "images")) == sorted(names)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
@pytest.mark.parametrize("query", ["image_fetch", "image_fetch_throttled"])
def test_queries_fetch_into_the_shared_folder_of_a_cluster(spark, tmp_path, monkeypatch, scheme, query):
    """A cluster's shared folder may be a mount without a scheme; names with '?' or '#' do not share a file."""
    urls = [f"http://h/{n}" for n in ("b", "b?x=1", "b?x=22", "b#top", "c")]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"{scheme}{tmp_path}/shared")
    master = spark.conf.get("spark.master")
    try:
        spark.conf.set("spark.master", "yarn")
    except Exception:
        pytest.skip("the master cannot be changed here")
    try:
        got = QUERIES[query](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.master", master)
    assert {r.url: r.n_bytes for r in got if r.status == "ok"} == {u: len(u) for u in urls if "#" not in u}
    assert [(r.url, r.error) for r in got if r.status == "error"] == [("http://h/b#top", "ValueError: link with a fragment")]
