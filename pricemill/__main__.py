"""Command line for the whole jobs: ``python -m pricemill predict products.csv out`` and the like."""

import argparse

from pyspark.sql import SparkSession

from pricemill import plans
from pricemill.schema import CHUNK_ROWS, PUBLIC_ROWS, SAMPLE_ROWS, SAMPLE_SEED
from pricemill.sources.csv import read_products, read_submission


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pricemill")
    jobs = top.add_subparsers(dest="job", required=True)

    predict = jobs.add_parser("predict", help="write hash prices for a product file")
    predict.add_argument("products")
    predict.add_argument("output")

    split = jobs.add_parser("split", help="write a product file as chunks")
    split.add_argument("products")
    split.add_argument("output")
    split.add_argument("--priced", action="store_true")
    split.add_argument("--chunk-rows", type=int, default=CHUNK_ROWS)

    sample = jobs.add_parser("sample", help="draw rows from one chunk")
    sample.add_argument("chunks")
    sample.add_argument("output")
    sample.add_argument("--priced", action="store_true")
    sample.add_argument("--chunk", type=int, default=1)
    sample.add_argument("--rows", type=int, default=SAMPLE_ROWS)
    sample.add_argument("--seed", default=SAMPLE_SEED)

    evaluate = jobs.add_parser("evaluate", help="check and score a submission")
    evaluate.add_argument("submission")
    evaluate.add_argument("truth", help="priced product file")

    rank = jobs.add_parser("rank", help="rank submissions")
    rank.add_argument("truth", help="priced product file")
    rank.add_argument("submissions", nargs="+", metavar="NAME=PATH")
    rank.add_argument("--public-rows", type=int, default=PUBLIC_ROWS)
    rank.add_argument("--seed", default=SAMPLE_SEED)

    for job in (predict, split, sample):
        job.add_argument("--overwrite", action="store_true")
    for job in (predict, split):
        job.add_argument("--one-line", action="store_true", help="no text holds a newline: split large files")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"pricemill-{args.job}").getOrCreate()
    mode = "overwrite" if getattr(args, "overwrite", False) else "errorifexists"
    if args.job == "predict":
        plans.predict_file(spark, args.products, args.output, mode=mode, multi_line=not args.one_line).show(truncate=False)
        read_submission(spark, args.output).show(5)
    elif args.job == "split":
        counts = plans.split_file(
            spark, args.products, args.output, args.priced, args.chunk_rows, mode, multi_line=not args.one_line
        )
        counts.orderBy("chunk").show()
    elif args.job == "sample":
        plans.sample_file(
            spark, args.chunks, args.output, args.priced, args.chunk, args.rows, args.seed, mode
        ).show(5)
    elif args.job == "evaluate":
        truth = read_products(spark, args.truth, priced=True)
        plans.evaluate(spark, args.submission, truth).show(truncate=False)
    else:
        truth = read_products(spark, args.truth, priced=True)
        files = dict(entry.split("=", 1) for entry in args.submissions)
        board = plans.rank(spark, files, truth, args.public_rows, args.seed)
        board.orderBy("final_rank").show(truncate=False)


if __name__ == "__main__":
    main()
