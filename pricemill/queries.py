"""The operators as queries over a folder of Parquet tables, each with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.functions.hashing import hash_price
from pricemill.functions.links import link_basename, target_path
from pricemill.operators import catalog
from pricemill.operators.chunking import assign_chunks, chunk_counts, read_indexed_csv, with_chunk
from pricemill.operators.groups import grouped_holdout
from pricemill.operators.images import fetch_images, image_manifest, pending_images, store_for
from pricemill.operators.leaderboard import leaderboard, public_score
from pricemill.operators.model import fit_price_model
from pricemill.operators.predict import batch_predictor, hash_predictor, predict, row_predictor
from pricemill.operators.profile import DISTINCT_ERROR, RANK_ERROR, merge_profiles, profile, sketch_profile
from pricemill.operators.quantiles import exact_quantiles
from pricemill.operators.sampling import sample_exact
from pricemill.operators.scoring import error_metrics, smape
from pricemill.operators.selection import LinearPrices, cross_validate, stack_weights, stacked
from pricemill.operators.segments import PRICE_BANDS, error_by_segment, leaderboard_bootstrap
from pricemill.operators.tfidf import TextVocabulary, fit_vocabulary
from pricemill.operators.throttle import Clock, Refused, Throttle, fetch_throttled
from pricemill.operators.validation import check_submission, evaluate_submission
from pricemill.schema import NULL_TOKENS, SUBMISSION_SCHEMA, TRAIN_SCHEMA
from pricemill.sources.csv import headers, read_products, read_submission, write_csv
from pricemill.sources.quarantine import read_csv_marked
from pricemill.sources.files import list_files, read_chunks, write_chunks
from pricemill.sources.staging import new_folder, new_path, staged

IMAGE_FOLDER = "images"
CHUNK_ROWS = 3750
TEAMS = 5
PUBLIC_SEED = 7

# The part table read as products; the text is valid in Spark and in DuckDB.
PRODUCTS_SQL = """
select p_partkey as sample_id,
       concat(p_name, ' ', p_brand, ' ', p_type, ' Pack of ', cast(p_size as string)) as catalog_content,
       case when p_partkey % 97 = 0 then null
            else concat('https://img.example.com/I/', substr(md5(cast(p_partkey as string)), 1, 3), '.jpg')
       end as image_link,
       p_retailprice as price
from part
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        PRODUCTS_SQL.replace("from part", "from {part}"), part=_table(spark, sf_dir, "part")
    )


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("price"))


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete submission per team, and as the last one the order lines, which repeat and miss ids."""
    truth = _truth(spark, sf_dir)
    teams = F.explode(F.sequence(F.lit(1), F.lit(TEAMS))).alias("submission_id")
    complete = truth.select("sample_id", teams).select(
        "submission_id",
        "sample_id",
        F.round(5 + 495 * _unit(F.col("submission_id"), F.col("sample_id")), 2).alias("price"),
    )
    lines = _table(spark, sf_dir, "lineitem").select(
        F.lit(TEAMS + 1).alias("submission_id"),
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_extendedprice").alias("price"),
    )
    return complete.unionByName(lines)


def _unit(*keys):
    digest = F.md5(F.concat_ws(":", *[key.cast("string") for key in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _third(df: DataFrame) -> int:
    """A third of the rows: the share of the test rows that public scores use."""
    return df.count() // 3


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def csv_roundtrip(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"),
        F.col("text").alias("catalog_content"),
        F.col("source").alias("image_link"),
        F.col("n_chars").cast("double").alias("price"),
    )
    path = new_path(spark, "csv-roundtrip")
    write_csv(documents, path)
    return read_products(spark, path, priced=True)


def submission_roundtrip(spark, sf_dir):
    path = new_path(spark, "submission-roundtrip")
    write_csv(_truth(spark, sf_dir), path)
    return read_submission(spark, path)


def chunk_assign(spark, sf_dir):
    return assign_chunks(_table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], CHUNK_ROWS)


def chunk_copies(spark, sf_dir):
    """Rows with nothing but the priority: nearly all are whole copies of each other."""
    return assign_chunks(_table(spark, sf_dir, "orders").select("o_orderpriority"), "o_orderpriority", CHUNK_ROWS)


ORDERS_AS_PRODUCTS = """
select o_orderkey as sample_id, concat(o_orderpriority, ' ', o_orderstatus, ' ', cast(o_custkey as string)) as catalog_content,
       o_orderstatus as image_link, o_totalprice as price from orders
"""


def _order_products(spark, sf_dir):
    text = ORDERS_AS_PRODUCTS.replace("from orders", "from {orders}")
    return spark.sql(text, orders=_table(spark, sf_dir, "orders"))


def chunk_file(spark, sf_dir):
    path = new_path(spark, "chunk-file")
    write_csv(_order_products(spark, sf_dir).orderBy("price", "sample_id"), path)
    return with_chunk(read_indexed_csv(spark, path, TRAIN_SCHEMA, multi_line=False), CHUNK_ROWS)


def chunk_counts_query(spark, sf_dir):
    return chunk_counts(chunk_assign(spark, sf_dir))


def _written_chunks(spark, sf_dir, **how):
    chunked = assign_chunks(_order_products(spark, sf_dir), ["price", "sample_id"], CHUNK_ROWS)
    path = new_path(spark, "chunk-write")
    write_chunks(chunked, path, **how)
    return path


def chunk_write(spark, sf_dir):
    path = _written_chunks(spark, sf_dir, one_file=False)
    return (
        read_chunks(spark, path, TRAIN_SCHEMA, multi_line=False)
        .groupBy("chunk")
        .agg(
            F.count("*").alias("n_rows"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
            F.sum("sample_id").alias("id_sum"),
            F.sum(F.length("catalog_content")).alias("letters"),
        )
    )


def list_chunks(spark, sf_dir):
    files = list_files(spark, _written_chunks(spark, sf_dir))
    chunk = F.regexp_extract("path", r"/chunk=(\d+)/", 1).cast("bigint")
    return files.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n_files"), (F.min("n_bytes") > 0).alias("filled"))


def header_check(spark, sf_dir):
    """Ten folders of one file each, by the last digit of the id; three have headers that differ."""
    path = new_path(spark, "header-check")
    truth = _truth(spark, sf_dir).withColumn("digit", F.col("sample_id") % 10)
    right = truth.filter("digit not in (3, 5, 7)")
    wrong = truth.filter("digit in (3, 7)").withColumnRenamed("price", "Price")
    extra = truth.filter("digit = 5").withColumn("note", F.lit("x"))
    for part in (right, wrong, extra):
        part.repartition("digit").write.mode("append").partitionBy("digit").option("header", True).csv(path)
    found = headers(spark, path, SUBMISSION_SCHEMA).select(
        F.regexp_extract("file", r"/digit=(\d)/", 1).cast("bigint").alias("digit"), "header", "good"
    )
    return found.groupBy("digit", "header", "good").agg(F.count("*").alias("n_files"))


def sample_exact_query(spark, sf_dir):
    return sample_exact(_table(spark, sf_dir, "orders"), key="o_orderkey")


def sample_third(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return sample_exact(orders, _third(orders), "o_orderkey").select("o_orderkey", "o_totalprice")


def sample_first_chunk(spark, sf_dir):
    return sample_exact(chunk_assign(spark, sf_dir).filter("chunk = 1"), key="o_orderkey")


def predict_project(spark, sf_dir):
    return predict(products(spark, sf_dir), hash_predictor())


def _example_price(sample_id, catalog_content, image_link):
    extra = 0.0 if image_link is not None else 0.5
    if not isinstance(sample_id, (int, type(None))):
        return -1.0
    return 5.0 + (len(catalog_content) + (sample_id or 0)) % 496 + extra


def predict_rows(spark, sf_dir):
    """Every 50th product has no id: the others keep whole numbers as ids, beyond 2**53 as well."""
    table = products(spark, sf_dir).withColumn(
        "sample_id", F.when(F.col("sample_id") % 50 != 0, F.col("sample_id") + 9007199254740993)
    )
    return predict(table, row_predictor(_example_price))


def _per_letter_model():
    return lambda text: 0.25 * text.str.len()


def predict_batches(spark, sf_dir):
    predictor = batch_predictor(_per_letter_model, ["catalog_content"])
    return predict(products(spark, sf_dir), predictor)


def prediction_count(spark, sf_dir):
    path = new_path(spark, "prediction-count")
    write_csv(predict_project(spark, sf_dir), path)
    return read_submission(spark, path).agg(F.count("*").alias("n_predictions"))


def smape_query(spark, sf_dir):
    table = products(spark, sf_dir)
    return _rounded(smape(predict(table), table), "smape")


def error_metrics_query(spark, sf_dir):
    table = products(spark, sf_dir)
    return _rounded(error_metrics(predict(table), table), "smape", "mae", "rmse", "r2")


def metrics_incomplete(spark, sf_dir):
    """Order lines as predictions of the parts: ids missing, ids extra, ids repeated."""
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_extendedprice").alias("price")
    )
    table = products(spark, sf_dir)
    return error_metrics(lines, table)


def truth_repeats(spark, sf_dir):
    """Truth with repeated ids: one price per order line. Nothing can be scored against it."""
    truth = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_extendedprice").alias("price")
    )
    return evaluate_submission(predict(truth.select("sample_id").distinct()), truth)


FAULTS_SQL = """
select sample_id, case when sample_id % 107 = 0 then -1 when sample_id % 107 = 1 then cast('NaN' as double)
                       when sample_id % 107 = 2 then null else 10 end as price
from (select p_partkey as sample_id from part where p_partkey % 101 != 0
      union all select -p_partkey - 1 from part where p_partkey % 500 = 0
      union all select p_partkey from part where p_partkey % 103 = 0 and p_partkey % 101 != 0)
"""


def submission_faults(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    submission = spark.sql(FAULTS_SQL.replace("from part", "from {part}"), part=part)
    return check_submission(submission, part.select(F.col("p_partkey").alias("sample_id")))


def holdout_split(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", "o_totalprice", catalog.in_holdout("o_orderkey", 0.2).alias("holdout"))


def catalog_clean(spark, sf_dir):
    """Parts by name and size stand for products with repeated ids, blank texts and bad prices."""
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        F.when(F.col("l_linenumber") == 3, "  ").otherwise(F.concat_ws("  ", F.lit(" line"), "l_linenumber")).alias("catalog_content"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("price"),
    )
    return catalog.clean(rows)


def price_outliers(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return catalog.flag_outliers(rows, 0.5)


def price_ensemble(spark, sf_dir):
    """Two hash models for all parts and one that covers two thirds of them."""
    table = products(spark, sf_dir)
    members = {
        "a": (predict(table, hash_predictor("a")), 2.0),
        "b": (predict(table, hash_predictor("b")), 1.0),
        "c": (predict(table.filter("sample_id % 3 != 0"), hash_predictor("c")), 1.0),
    }
    return _rounded(catalog.ensemble(members), "price")


def pack_quantity(spark, sf_dir):
    return products(spark, sf_dir).select("sample_id", catalog.pack_quantity().alias("pack"))


def price_model(spark, sf_dir):
    """Documents as products, their length as the price: a model of the texts prices the held-out ones."""
    table = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("catalog_content"), F.col("n_chars").cast("double").alias("price")
    )
    held = catalog.in_holdout("sample_id", 0.2)
    model = fit_price_model(table.filter(~held), table.filter(held), 128)
    return model.predict(table.filter(held))


def catalog_profile(spark, sf_dir):
    return profile(products(spark, sf_dir))


def price_quantiles(spark, sf_dir):
    """Every twentieth of the line prices, from counts of their leading bits."""
    shares = [i / 20 for i in range(21)]
    values = exact_quantiles(_table(spark, sf_dir, "lineitem"), "l_extendedprice", shares)
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "twentieth long, price double")


QUARANTINE_LINES = """
select o_orderkey as sample_id, o_orderkey % 10 as digit,
       case when o_orderkey % 13 = 1 then concat(cast(o_orderkey as string), ',abc')
            when o_orderkey % 13 = 2 then concat(cast(o_orderkey as string), ',5,extra')
            when o_orderkey % 13 = 3 then cast(o_orderkey as string)
            when o_orderkey % 13 = 4 then concat(cast(o_orderkey as string), ',-3.5')
            when o_orderkey % 13 = 5 then concat('x', cast(o_orderkey as string), ',"1,5"')
            else concat(cast(o_orderkey as string), ',', cast(o_custkey as string), '.5') end as line
from orders
"""


def csv_quarantine(spark, sf_dir):
    """Ten files by the last digit of the id: one with another header, and bad lines in all others."""
    lines = spark.sql(QUARANTINE_LINES.replace("from orders", "from {orders}"), orders=_table(spark, sf_dir, "orders"))
    titles = lines.select(F.lit(-1).cast("long").alias("sample_id"), "digit").distinct()
    title = F.when(F.col("digit") == 7, "sample_id,Price").otherwise("sample_id,price").alias("line")
    path = new_path(spark, "quarantine")
    rows = lines.unionByName(titles.select("sample_id", "digit", title))
    rows.repartition("digit").sortWithinPartitions("digit", "sample_id").select("digit", F.col("line").alias("value")).write.partitionBy(
        "digit"
    ).text(path)
    marked = read_csv_marked(spark, path, SUBMISSION_SCHEMA, multi_line=False, positive=["price"])
    digit = F.regexp_extract("file", r"/digit=(\d)/", 1).cast("bigint").alias("digit")
    return marked.select(digit, "sample_id", "price", "record", "reason")


def profile_merge(spark, sf_dir):
    """Order profiles stored per priority and merged, beside the exact counts: the errors that are promised hold."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    stored = staged(sketch_profile(orders, "o_orderpriority"), "part-profiles")
    merged = staged(merge_profiles(stored), "merged-profile")
    exact = profile(orders).select("column", F.col("n_distinct").alias("exact"))
    # The rank of every merged quartile, from one pass over the rows; three columns have quartiles.
    quartiles = {r.column: r for r in merged.filter("median is not null").collect()}
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    firm = F.lit(None).cast("boolean")
    if quartiles:
        at = {(c, q): F.avg((F.col(c) <= F.lit(r[q])).cast("double")) for c, r in quartiles.items() for q in shares}
        under = {(c, q): F.avg((F.col(c) < F.lit(r[q])).cast("double")) for c, r in quartiles.items() for q in shares}
        names = {key: f"r{i}" for i, key in enumerate(at)}
        ranks = orders.agg(*[at[k].alias(n) for k, n in names.items()], *[under[k].alias("u" + n) for k, n in names.items()]).first()
        good = {
            c: all(ranks["u" + names[c, q]] - RANK_ERROR <= share <= ranks[names[c, q]] + RANK_ERROR for q, share in shares.items())
            for c in quartiles
        }
        for c, yes in good.items():
            firm = F.when(F.col("column") == c, F.lit(yes)).otherwise(firm)
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= DISTINCT_ERROR * F.col("exact")
    joined = merged.join(exact, "column")
    return joined.select(
        "column", "n_rows", "n_nulls", "shortest", "longest", "low", "high", F.col("exact").alias("n_distinct"), near.alias("distinct_near"), firm.alias("quartiles_near")
    )


def text_tfidf(spark, sf_dir):
    """Weights of all words of all documents, from a vocabulary that was saved and loaded."""
    table = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("catalog_content"))
    path = new_path(spark, "text-vocabulary")
    fit_vocabulary(table).save(path)
    vectors = TextVocabulary.load(spark, path).vectors(table)
    entries = vectors.select("sample_id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return entries.select("sample_id", F.col("e.indices").alias("idx"), F.round("e.values", 6).alias("weight"))


# Three neighbours share a text, but for case and signs; every fifth part has the link of the part 7 further on.
GROUPED_SQL = """
select p_partkey as sample_id,
       concat(case when p_partkey % 2 = 0 then 'LAMP, no. ' else 'lamp no  ' end, cast(floor(p_partkey / 3) as bigint)) as catalog_content,
       case when p_partkey % 11 = 0 then null
            else concat('https://img.example.com/', cast(p_partkey + case when p_partkey % 5 = 0 then 7 else 0 end as string), '.jpg') end as image_link
from part
"""


def holdout_grouped(spark, sf_dir):
    rows = spark.sql(GROUPED_SQL.replace("from part", "from {part}"), part=_table(spark, sf_dir, "part"))
    return grouped_holdout(rows, 0.2).select("sample_id", "group", "holdout")


def error_by_segment_query(spark, sf_dir):
    """Hash prices of the parts that are no multiple of 7, by band of the true price, brand and type."""
    table = products(spark, sf_dir)
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    truth = table.select("sample_id", "price").join(part, "sample_id")
    errors = error_by_segment(predict(table.filter("sample_id % 7 != 0")), truth, ["brand", "type"])
    return _rounded(errors, "smape", "mae", "rmse", "r2")


BOOTSTRAP_REPLICATES = 40


def leaderboard_bootstrap_query(spark, sf_dir):
    return leaderboard_bootstrap(_submissions(spark, sf_dir), _truth(spark, sf_dir), BOOTSTRAP_REPLICATES)


PRICE_FEATURES = ["sample_id % 1000 / 1000D", "sample_id / 10000D", "length(catalog_content)", "length(catalog_content) * (sample_id % 1000) / 1000D"]


def price_cv(spark, sf_dir):
    """Folds of the parts: the price by id, as the catalog sets it, and text length; the model is stored and reloaded."""
    table = products(spark, sf_dir)
    model, scores = cross_validate(table, PRICE_FEATURES)
    path = new_path(spark, "price-weights")
    model.save(spark, path)
    n_priced = LinearPrices.load(spark, path).predict(table).agg(F.count_if(F.col("price") > 0).alias("n")).scalar()
    per_fold = scores.groupBy("fold").agg(
        F.max("n_rows").alias("n_rows"),
        F.round(F.max("baseline_smape"), 6).alias("baseline_smape"),
        (F.min("smape") < F.max("baseline_smape")).alias("better"),
    )
    return per_fold.withColumn("n_priced", n_priced)


def price_stack(spark, sf_dir):
    """Two noisy models of the part prices, weighted on a tenth of the parts, applied to all."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_retailprice").alias("price"))
    key = F.col("sample_id")
    table = part.select(
        "sample_id", "price", (F.col("price") * (0.8 + 0.4 * _unit(F.lit("a"), key))).alias("a"), (F.col("price") * (0.5 + 0.6 * _unit(F.lit("b"), key))).alias("b")
    )
    members = {m: table.select("sample_id", F.col(m).alias("price")) for m in "ab"}
    weights = stack_weights(members, table.filter(catalog.in_holdout("sample_id", 0.1)).select("sample_id", "price"))
    return _rounded(stacked(members, weights), "price")


class _RefusingFetcher:
    """Refuses the first try of half of the links and every try of some."""

    def __init__(self):
        self.seen = set()

    def __call__(self, url):
        import hashlib

        kind = hashlib.md5(url.encode()).hexdigest()[0]
        if "#" in url:
            raise ValueError("link with a fragment")
        first = url not in self.seen
        self.seen.add(url)
        if kind == "0" or (kind < "8" and first):
            raise Refused("come back later")
        return url.encode()


class _TaskTime:
    """A clock that only sleeping moves."""

    def __init__(self):
        self.time = 0.0

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.time += seconds


def image_fetch_throttled(spark, sf_dir):
    folder = new_folder(spark, "throttled-images")
    work = image_manifest_query(spark, sf_dir).withColumn("path", target_path(folder, "filename"))
    time = _TaskTime()
    throttle = Throttle(rate=50, attempts=3, clock=Clock(time.now, time.sleep))
    log = fetch_throttled(work, _RefusingFetcher(), store_for(folder, shared=True), throttle, spark.sparkContext.defaultParallelism)
    log = staged(log, "throttled-log")
    return log.select("filename", "url", "status", "n_bytes", "error", "host", "attempts")


def submission_check(spark, sf_dir):
    expected = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"))
    submission = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("price"),
    )
    return check_submission(submission, expected)


def submission_evaluate(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    scored = evaluate_submission(predict(truth), truth)
    return _rounded(scored, "smape", "mae", "rmse", "r2")


def public_score_query(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return public_score(_submissions(spark, sf_dir), truth, _third(truth), PUBLIC_SEED)


def leaderboard_query(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return leaderboard(_submissions(spark, sf_dir), truth, _third(truth), PUBLIC_SEED)


def _links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image_link"))


def url_basename(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "image_link", link_basename("image_link").alias("filename")
    )


def image_manifest_query(spark, sf_dir):
    return image_manifest(_links(spark, sf_dir), IMAGE_FOLDER)


def image_manifest_products(spark, sf_dir):
    return image_manifest(products(spark, sf_dir), IMAGE_FOLDER)


def image_pending(spark, sf_dir):
    manifest = image_manifest_query(spark, sf_dir)
    came_through = F.substring(F.md5("filename"), 1, 1) < "8"
    status = manifest.select("filename", F.when(came_through, "ok").otherwise("error").alias("status"))
    return pending_images(manifest, status)


def _echo_fetcher(url):
    if "#" in url:
        raise ValueError("link with a fragment")
    return url.encode()


def _refusing_fetcher(url):
    raise ValueError("not stored")


def image_fetch(spark, sf_dir):
    manifest = image_manifest_query(spark, sf_dir)
    folder = new_folder(spark, "images")
    # It lies in the folder that every executor reaches.
    store = store_for(folder, shared=True)
    n_tasks = spark.sparkContext.defaultParallelism
    work = manifest.withColumn("path", target_path(folder, "filename"))
    log = staged(fetch_images(work, _echo_fetcher, store, n_tasks), "image-log")
    # The second round finds what the first one stored: the sizes come from the files.
    again = fetch_images(work, _refusing_fetcher, store, n_tasks)
    both = log.join(again.select("filename", F.col("n_bytes").alias("stored_bytes")), "filename")
    return both.select("filename", "url", "status", "n_bytes", "stored_bytes", "error")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "submission_roundtrip": submission_roundtrip,
    "chunk_assign": chunk_assign,
    "chunk_file": chunk_file,
    "chunk_counts": chunk_counts_query,
    "chunk_copies": chunk_copies,
    "chunk_write": chunk_write,
    "list_chunks": list_chunks,
    "header_check": header_check,
    "sample_exact": sample_exact_query,
    "sample_third": sample_third,
    "sample_first_chunk": sample_first_chunk,
    "predict_project": predict_project,
    "predict_rows": predict_rows,
    "predict_batches": predict_batches,
    "prediction_count": prediction_count,
    "smape": smape_query,
    "error_metrics": error_metrics_query,
    "metrics_incomplete": metrics_incomplete,
    "truth_repeats": truth_repeats,
    "submission_faults": submission_faults,
    "holdout_split": holdout_split,
    "catalog_clean": catalog_clean,
    "price_outliers": price_outliers,
    "price_ensemble": price_ensemble,
    "pack_quantity": pack_quantity,
    "price_model": price_model,
    "catalog_profile": catalog_profile,
    "price_quantiles": price_quantiles,
    "price_cv": price_cv,
    "price_stack": price_stack,
    "image_fetch_throttled": image_fetch_throttled,
    "csv_quarantine": csv_quarantine,
    "profile_merge": profile_merge,
    "text_tfidf": text_tfidf,
    "holdout_grouped": holdout_grouped,
    "error_by_segment": error_by_segment_query,
    "leaderboard_bootstrap": leaderboard_bootstrap_query,
    "submission_check": submission_check,
    "submission_evaluate": submission_evaluate,
    "public_score": public_score_query,
    "leaderboard": leaderboard_query,
    "url_basename": url_basename,
    "image_manifest": image_manifest_query,
    "image_manifest_products": image_manifest_products,
    "image_pending": image_pending,
    "image_fetch": image_fetch,
}

# --- the same in SQL -------------------------------------------------------------------------------

_TOKENS = ", ".join("'" + token + "'" for token in NULL_TOKENS)


def _sql_unit(text: str) -> str:
    return f"(cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296.0)"


def _sql_price(text: str) -> str:
    return f"round(5 + 495 * {_sql_unit(text)}, 2)"


def _sql_check(submission: str, expected: str) -> str:
    return f"""
with submitted as ({submission}), expected as ({expected}),
got as (select sample_id, count(*) as n, count(*) filter (where price is null or isnan(price) or isinf(price) or price <= 0) as bad
        from submitted group by sample_id),
wanted as (select sample_id, count(*) as copies from expected group by sample_id),
ids as (select w.sample_id as e, g.sample_id as g, copies, n, bad
        from wanted w full outer join got g on w.sample_id = g.sample_id),
counts as (select count(e) as n_expected, cast(coalesce(sum(n), 0) as bigint) as n_got,
                  count(*) filter (where g is null) as missing,
                  count(*) filter (where e is null) as extra,
                  count(*) filter (where n > 1) as dup_ids,
                  cast(coalesce(sum(bad), 0) as bigint) as bad_price,
                  count(*) filter (where copies > 1) as dup_truth
           from ids)
select *, missing + extra + dup_ids + bad_price + dup_truth = 0 as ok from counts
"""


# A complete output: the counts are computed all the same.
_CLEAN_COUNTS = """count(*) as n_pairs, count(*) filter (where a is null or p is null or isnan(p)) as n_bad,
       (select count(*) from part) - count(a) as n_missing, count(*) - count(a) as n_extra,
       count(*) - (select count(distinct p_partkey) from part) as n_repeated"""


_CHUNKED = f"""
select *, idx // {CHUNK_ROWS} + 1 as chunk
from (select *, row_number() over (order by o_totalprice, o_orderkey) - 1 as idx from orders)
"""
_CHUNKED_PRODUCTS = f"""
select *, idx // {CHUNK_ROWS} + 1 as chunk
from (select *, row_number() over (order by price, sample_id) - 1 as idx from ({ORDERS_AS_PRODUCTS}))
"""

_PRICED = f"""
with products as ({PRODUCTS_SQL}),
pairs as (select price as a, {_sql_price("concat('42:', sample_id)")} as p from products),
terms as (select a, p, p - a as e,
                 case when abs(a) + abs(p) = 0 then 0
                      else 100 * (abs(p - a) / ((abs(a) + abs(p)) / 2)) end as s from pairs)
"""

_SCORES = f"""
with truth as (select o_orderkey as sample_id, o_totalprice as a,
                      row_number() over (order by md5(concat('{PUBLIC_SEED}:', o_orderkey)), o_orderkey)
                        <= (select count(*) // 3 from orders) as shown
               from orders),
submissions as (
    select team as submission_id, o_orderkey as sample_id,
           {_sql_price("concat(team, ':', o_orderkey)")} as price
    from orders, (select unnest(range(1, {TEAMS + 1})) as team)
    union all
    select {TEAMS + 1}, l_orderkey, l_extendedprice from lineitem),
per_id as (select submission_id, sample_id, count(*) as n, max(price) as p,
                  count(*) filter (where price is null or isnan(price) or isinf(price) or price <= 0) as bad
           from submissions group by all),
terms as (select per_id.*, truth.sample_id is not null as known, shown,
                 case when abs(a) + abs(p) = 0 then 0
                      else 100 * (abs(p - a) / ((abs(a) + abs(p)) / 2)) end as s
          from per_id left join truth using (sample_id)),
checked as (select cast(submission_id as integer) as submission_id,
                   count(*) filter (where known) = (select count(*) from truth)
                     and bool_and(known) and max(n) = 1 and sum(bad) = 0 as ok,
                   count(*) filter (where shown) as n_public,
                   round(avg(s) filter (where shown), 6) as shown_smape,
                   round(avg(s), 6) as full_smape
            from terms group by submission_id),
scores as (select submission_id, ok, n_public,
                  case when ok then shown_smape end as public_smape,
                  case when ok then full_smape end as final_smape from checked)
"""

def _sql_band(price: str) -> str:
    names = [f"{e:g}" for e in PRICE_BANDS]
    cases = [f"when {price} < {names[0]} then 'under {names[0]}'"]
    cases += [f"when {price} < {high} then '{low}-{high}'" for low, high in zip(names, names[1:])]
    return f"case {' '.join(cases)} else '{names[-1]} and over' end"


_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
_BOOTSTRAP = f"""
{_SCORES.replace("checked as", "unused as")},
drawn as (select submission_id, sample_id, s, unnest(range({BOOTSTRAP_REPLICATES} + 1)) as r
          from terms where known and not isnan(p) and not isinf(p)),
digests as (select *, md5(concat('42:', length(cast(sample_id as varchar)), ':', sample_id, ':', length(cast(r // 8 as varchar)), ':', r // 8)) as d from drawn),
bits as (select *, cast(concat('0x', substr(d, (r % 8) * 4 + 1, 4)) as int) as b from digests),
weighed as (select submission_id, r, s, case when r = 0 then 1 else {" + ".join(f"(b >= {int(c * 65536 + 0.5)})::int" for c in _POISSON)} end as w from bits),
sums as (select submission_id, r, cast(sum(w) as bigint) as n, round(sum(w * s) / sum(w), 6) as score from weighed group by all having sum(w) > 0),
ranked as (select *, rank() over (partition by r order by score) as place from sums),
placed as (select submission_id, place, row_number() over (partition by submission_id order by place, r) as k,
                  count(*) over (partition by submission_id) as total from ranked where r > 0),
intervals as (select submission_id, min(place) filter (where k >= total * 0.025) as low_rank, min(place) filter (where k >= total * 0.975) as high_rank,
                     avg(cast(place = 1 as double)) as first_share from placed group by submission_id)
select cast(submission_id as integer) as submission_id, n as n_scored, score as smape, cast(place as integer) as "rank",
       cast(low_rank as integer) as low_rank, cast(high_rank as integer) as high_rank, first_share
from ranked left join intervals using (submission_id) where r = 0
"""

_PROFILE_MERGE = " union all ".join(
    f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_nulls,
       cast({f"min(length({c}))" if text else "null"} as integer) as shortest, cast({f"max(length({c}))" if text else "null"} as integer) as longest,
       cast({"null" if text else f"min({c})"} as double) as low, cast({"null" if text else f"max({c})"} as double) as high,
       count(distinct {c}) as n_distinct, true as distinct_near, cast({"null" if text else "true"} as boolean) as quartiles_near
from orders"""
    for c, text in (("o_orderkey", False), ("o_custkey", False), ("o_totalprice", False), ("o_orderstatus", True))
)

_BASENAME = (
    r"regexp_extract(regexp_replace(image_link, '(/+\.?)+$|^\.$', ''), '([^/]*)$', 1)"
)


def _sql_manifest(source: str) -> str:
    return f"""
select filename, min(image_link) as url, count(distinct image_link) as n_urls,
       concat('{IMAGE_FOLDER}/', filename) as path
from (select image_link, {_BASENAME} as filename from ({source}) where image_link is not null)
where filename not in ('', '..') group by filename
"""


_PAGE_LINKS = "select page_id, url as image_link from pages"
_PAGE_MANIFEST = _sql_manifest(_PAGE_LINKS)

ORACLE_SQL = {
    "csv_roundtrip": f"""
select doc_id as sample_id, case when text not in ({_TOKENS}) then text end as catalog_content,
       case when source not in ({_TOKENS}) then source end as image_link,
       cast(n_chars as double) as price
from documents
""",
    "submission_roundtrip": "select o_orderkey as sample_id, o_totalprice as price from orders",
    "chunk_assign": _CHUNKED,
    "chunk_copies": f"""
select o_orderpriority, idx, idx // {CHUNK_ROWS} + 1 as chunk
from (select o_orderpriority, row_number() over (order by o_orderpriority) - 1 as idx from orders)
""",
    "chunk_file": _CHUNKED_PRODUCTS,
    "chunk_counts": f"select chunk, count(*) as n_rows from ({_CHUNKED}) group by chunk",
    "chunk_write": f"""
select chunk, count(*) as n_rows, min(price) as low, max(price) as high,
       cast(sum(sample_id) as bigint) as id_sum, cast(sum(length(catalog_content)) as bigint) as letters
from ({_CHUNKED_PRODUCTS}) group by chunk
""",
    "list_chunks": f"""
select chunk, cast(1 as bigint) as n_files, count(*) > 0 as filled from ({_CHUNKED_PRODUCTS}) group by chunk
""",
    "header_check": """
select digit, header, header = 'sample_id,price' as good, cast(1 as bigint) as n_files
from (select distinct o_orderkey % 10 as digit,
             case when o_orderkey % 10 in (3, 7) then 'sample_id,Price'
                  when o_orderkey % 10 = 5 then 'sample_id,price,note' else 'sample_id,price' end as header
      from orders)
""",
    "sample_exact": """
select * from orders order by md5(concat('42:', o_orderkey)), o_orderkey limit 50
""",
    "sample_third": """
select o_orderkey, o_totalprice
from (select *, row_number() over (order by md5(concat('42:', o_orderkey)), o_orderkey) as k from orders)
where k <= (select count(*) // 3 from orders)
""",
    "sample_first_chunk": f"""
select * from ({_CHUNKED}) where chunk = 1 order by md5(concat('42:', o_orderkey)), o_orderkey limit 50
""",
    "predict_project": f"""
select sample_id, {_sql_price("concat('42:', sample_id)")} as price from ({PRODUCTS_SQL})
""",
    "predict_rows": f"""
select id as sample_id,
       cast(5 + (length(catalog_content) + coalesce(id, 0)) % 496
            + case when image_link is null then 0.5 else 0 end as double) as price
from (select *, case when sample_id % 50 != 0 then sample_id + 9007199254740993 end as id
      from ({PRODUCTS_SQL}))
""",
    "predict_batches": f"""
select sample_id, cast(length(catalog_content) / 4 as double) as price from ({PRODUCTS_SQL})
""",
    "prediction_count": "select count(*) as n_predictions from part",
    "smape": f"""
{_PRICED}
select {_CLEAN_COUNTS}, round(avg(s), 6) as smape from terms
""",
    "error_metrics": f"""
{_PRICED}
select {_CLEAN_COUNTS}, round(avg(s), 6) as smape,
       round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
       round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) as r2
from terms
""",
    "metrics_incomplete": """
with got as (select l_orderkey as g, count(*) as n from lineitem group by l_orderkey),
ids as (select p_partkey as e, g, n from part full outer join got on p_partkey = g)
select count(*) filter (where e is not null and g is not null) as n_pairs, cast(0 as bigint) as n_bad,
       count(*) filter (where g is null) as n_missing, count(*) filter (where e is null) as n_extra,
       count(*) filter (where n > 1) as n_repeated,
       cast(null as double) as smape, cast(null as double) as mae, cast(null as double) as rmse,
       cast(null as double) as r2
from ids
""",
    "truth_repeats": f"""
with ids as (select l_orderkey, count(*) as n from lineitem group by l_orderkey)
select count(*) as n_expected, count(*) as n_got, count(*) filter (where n < 1) as missing,
       count(*) filter (where n < 1) as extra, count(*) filter (where n < 1) as dup_ids,
       count(*) filter (where not {_sql_price("concat('42:', l_orderkey)")} > 0) as bad_price,
       count(*) filter (where n > 1) as dup_truth, count(*) filter (where n > 1) = 0 as ok,
       cast(null as double) as smape, cast(null as double) as mae, cast(null as double) as rmse,
       cast(null as double) as r2
from ids
""",
    "submission_faults": _sql_check(FAULTS_SQL, "select p_partkey as sample_id from part"),
    "submission_check": _sql_check(
        "select l_orderkey as sample_id, l_extendedprice * l_discount as price from lineitem",
        "select p_partkey as sample_id from part",
    ),
    "submission_evaluate": f"""
with pairs as (select o_orderkey, o_totalprice as a, {_sql_price("concat('42:', o_orderkey)")} as p from orders),
checked as ({_sql_check("select o_orderkey as sample_id, p as price from pairs", "select o_orderkey as sample_id from orders")}),
terms as (select a, p, p - a as e,
                 case when abs(a) + abs(p) = 0 then 0
                      else 100 * (abs(p - a) / ((abs(a) + abs(p)) / 2)) end as s from pairs),
metrics as (select round(avg(s), 6) as smape, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
                   round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) as r2 from terms)
select * from checked, metrics
""",
    "holdout_split": f"""
select o_orderkey, o_totalprice, {_sql_unit("concat('42:', o_orderkey)")} < 0.2 as holdout from orders
""",
    "catalog_clean": """
with rows as (select l_orderkey as sample_id, concat('line ', l_linenumber) as catalog_content,
                     l_extendedprice * l_discount as price
              from lineitem where l_linenumber != 3 and l_extendedprice * l_discount > 0)
select sample_id, catalog_content, price
from (select *, row_number() over (partition by sample_id order by catalog_content, price) as k from rows)
where k = 1
""",
    "price_outliers": """
with places as (select l_extendedprice as p, row_number() over (order by l_extendedprice) as k,
                       count(*) over () as n from lineitem),
quartiles as (select max(p) filter (where k = (n + 3) // 4) as q1,
                     max(p) filter (where k = (3 * n + 3) // 4) as q3 from places)
select l_orderkey, l_linenumber, l_extendedprice as price,
       l_extendedprice < q1 - 0.5 * (q3 - q1) or l_extendedprice > q3 + 0.5 * (q3 - q1) as outlier
from lineitem, quartiles
""",
    "price_ensemble": f"""
with models as (select sample_id, {_sql_price("concat('a:', sample_id)")} as a,
                       {_sql_price("concat('b:', sample_id)")} as b,
                       case when sample_id % 3 != 0 then {_sql_price("concat('c:', sample_id)")} end as c
                from ({PRODUCTS_SQL}))
select sample_id, round((2 * a + b + coalesce(c, 0)) / (case when c is null then 3 else 4 end), 6) as price,
       cast(case when c is null then 2 else 3 end as bigint) as n_members,
       cast(case when c is null then 1 else 0 end as double) as missing_weight
from models
""",
    "pack_quantity": "select p_partkey as sample_id, cast(p_size as bigint) as pack from part",
    "catalog_profile": f"""
with products as ({PRODUCTS_SQL})
select 'sample_id' as "column", count(*) as n_rows, count(*) - count(sample_id) as n_nulls,
       cast(null as integer) as shortest, cast(null as integer) as longest, count(distinct sample_id) as n_distinct
from products
union all
select 'catalog_content', count(*), count(*) - count(catalog_content),
       cast(min(length(catalog_content)) as integer), cast(max(length(catalog_content)) as integer),
       count(distinct catalog_content)
from products
union all
select 'image_link', count(*), count(*) - count(image_link), cast(min(length(image_link)) as integer),
       cast(max(length(image_link)) as integer), count(distinct image_link)
from products
union all
select 'price', count(*), count(*) - count(price), null, null, count(distinct price) from products
""",
    "price_quantiles": """
with places as (select l_extendedprice as p, row_number() over (order by l_extendedprice) as k, count(*) over () as n from lineitem)
select i as twentieth, max(p) filter (where k = greatest((i * n + 19) // 20, 1)) as price
from places, (select unnest(range(21)) as i) group by i
""",
    "csv_quarantine": f"""
with lines as ({QUARANTINE_LINES}), kinds as (select *, case when sample_id % 13 between 1 and 5 then sample_id % 13 else 0 end as k from lines)
select digit, case when k = 0 then sample_id end as sample_id, case when k = 0 then cast(split_part(line, ',', 2) as double) end as price,
       case when k > 0 then line end as record,
       case k when 1 then 'price is no double: abc' when 2 then '3 fields, not 2' when 3 then '1 fields, not 2'
              when 4 then 'price is not positive' when 5 then concat('sample_id is no bigint: x', sample_id) end as reason
from kinds where digit != 7
union all select distinct digit, cast(null as bigint), cast(null as double), 'sample_id,Price', 'header' from lines where digit = 7
""",
    "price_cv": f"""
with products as ({PRODUCTS_SQL}),
folds as (select price, cast(floor({_sql_unit("concat('42:', sample_id)")} * 5) as integer) as fold from products where price > 0),
sums as (select fold, sum(ln(price)) as s, count(*) as n from folds group by fold),
means as (select fold, exp(((select sum(s) from sums) - s) / ((select sum(n) from sums) - n)) as mean from sums)
select folds.fold, count(*) as n_rows, round(avg(100 * (abs(mean - price) / ((mean + price) / 2))), 6) as baseline_smape, true as better,
       (select count(*) from products) as n_priced
from folds join means using (fold) group by folds.fold
""",
    "price_stack": f"""
with rows as (select p_partkey as sample_id, p_retailprice as y, p_retailprice * (0.8::double + 0.4::double * {_sql_unit("concat('a:', p_partkey)")}) as a,
                     p_retailprice * (0.5::double + 0.6::double * {_sql_unit("concat('b:', p_partkey)")}) as b from part),
sums as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_
         from rows where {_sql_unit("concat('42:', sample_id)")} < 0.1),
weights as (select (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb from sums)
select sample_id, round(wa * a + wb * b, 6) as price, cast(2 as bigint) as n_members from rows, weights
""",
    "image_fetch_throttled": f"""
with kinds as (select *, substr(md5(url), 1, 1) as k, contains(url, '#') as lost from ({_PAGE_MANIFEST}))
select filename, url, case when lost or k = '0' then 'error' else 'ok' end as status,
       case when not lost and k != '0' then cast(strlen(url) as bigint) end as n_bytes,
       case when lost then 'ValueError: link with a fragment' when k = '0' then 'Refused: come back later' end as error,
       lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#]*)', 1)) as host,
       cast(case when lost then 1 when k = '0' then 3 when k < '8' then 2 else 1 end as integer) as attempts
from kinds
""",
    "profile_merge": _PROFILE_MERGE,
    "text_tfidf": """
with words as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as word from documents),
counted as (select doc_id, word, count(*) as n from words group by all),
vocabulary as (select word, count(*) as n_docs, row_number() over (order by count(*) desc, word) - 1 as idx from counted group by word)
select doc_id as sample_id, idx, round(n * ln(((select count(*) from documents) + 1.0) / (n_docs + 1.0)), 6) as weight
from counted join vocabulary using (word)
""",
    "holdout_grouped": f"""
with recursive products as ({GROUPED_SQL}),
keys as (select sample_id, trim(regexp_replace(lower(catalog_content), '[^a-z0-9]+', ' ', 'g')) as key from products
         union all select sample_id, image_link from products where image_link is not null),
edges as (select distinct a.sample_id as a, b.sample_id as b from keys a join keys b using (key)),
reached as (select sample_id as a, sample_id as b from products
            union select reached.a, edges.b from reached join edges on reached.b = edges.a),
grouped as (select a as sample_id, min(b) as "group" from reached group by a)
select sample_id, "group", {_sql_unit("""concat('42:', "group")""")} < 0.2 as holdout from grouped
""",
    "error_by_segment": f"""
with products as ({PRODUCTS_SQL}),
pairs as (select {_sql_band("price")} as band, p_brand as brand, p_type as type,
                 case when sample_id % 7 != 0 then price end as a,
                 case when sample_id % 7 != 0 then {_sql_price("concat('42:', sample_id)")} end as p
          from products join part on p_partkey = sample_id)
select band, brand, type, cast(grouping(band, brand, type) as bigint) as "grouping", count(*) as n_truth, count(p) as n_scored,
       round(avg(case when abs(a) + abs(p) = 0 then 0 else 100 * (abs(p - a) / ((abs(a) + abs(p)) / 2)) end), 6) as smape,
       round(avg(abs(p - a)), 6) as mae, round(sqrt(avg((p - a) * (p - a))), 6) as rmse,
       round(case when var_pop(a) * count(a) = 0 then null else 1 - sum((p - a) * (p - a)) / (var_pop(a) * count(a)) end, 6) as r2
from pairs group by cube (band, brand, type)
""",
    "leaderboard_bootstrap": _BOOTSTRAP,
    "public_score": f"""
{_SCORES}
select submission_id, n_public, ok, public_smape as smape from scores
""",
    "leaderboard": f"""
{_SCORES}
select submission_id, ok, public_smape,
       cast(case when ok then rank() over (order by public_smape nulls last) end as integer) as public_rank,
       final_smape,
       cast(case when ok then rank() over (order by final_smape nulls last) end as integer) as final_rank
from scores
""",
    "url_basename": f"select page_id, image_link, {_BASENAME} as filename from ({_PAGE_LINKS})",
    "image_manifest": _PAGE_MANIFEST,
    "image_manifest_products": _sql_manifest(PRODUCTS_SQL),
    "image_pending": f"""
select * from ({_PAGE_MANIFEST}) where substr(md5(filename), 1, 1) >= '8'
""",
    "image_fetch": f"""
select filename, url,
       case when contains(url, '#') then 'error' else 'ok' end as status,
       case when not contains(url, '#') then cast(strlen(url) as bigint) end as n_bytes,
       case when not contains(url, '#') then cast(strlen(url) as bigint) end as stored_bytes,
       case when contains(url, '#') then 'ValueError: link with a fragment' end as error
from ({_PAGE_MANIFEST})
""",
}
