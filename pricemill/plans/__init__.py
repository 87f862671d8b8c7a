"""Whole jobs made of the operators: predict, split and sample, fetch images, evaluate."""

from pricemill.plans.evaluate import evaluate, rank
from pricemill.plans.fetch import fetch
from pricemill.plans.prediction import predict_file
from pricemill.plans.split import land_file, sample_file, split_file

__all__ = ["evaluate", "fetch", "land_file", "predict_file", "rank", "sample_file", "split_file"]
