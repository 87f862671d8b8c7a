"""Catalog price prediction as Spark batch jobs: read, split, sample, predict, check, score, rank, fetch."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from pricemill.functions.hashing import hash_price, seeded_digest, unit_hash
from pricemill.functions.links import link_basename, target_path
from pricemill.operators.catalog import (
    clean,
    ensemble,
    flag_outliers,
    in_holdout,
    pack_quantity,
    price_fences,
)
from pricemill.operators.chunking import (
    assign_chunks,
    chunk_counts,
    read_indexed_csv,
    row_index,
    with_chunk,
)
from pricemill.operators.groups import grouped_holdout, leaks, product_groups
from pricemill.operators.images import (
    ArrowStore,
    FolderStore,
    fetch_images,
    image_manifest,
    pending_images,
)
from pricemill.operators.leaderboard import leaderboard, public_score, score_submissions
from pricemill.operators.model import PriceModel, fit_price_model, text_features
from pricemill.operators.predict import batch_predictor, hash_predictor, predict, row_predictor
from pricemill.operators.profile import merge_profiles, profile, read_profile, sketch_profile, write_profile
from pricemill.operators.quantiles import exact_quantiles, nth_values
from pricemill.operators.sampling import in_sample, sample_exact
from pricemill.operators.scoring import error_metrics, smape
from pricemill.operators.selection import LinearPrices, cross_validate, stack_weights, stacked
from pricemill.operators.segments import error_by_segment, leaderboard_bootstrap, price_band
from pricemill.operators.tfidf import TextVocabulary, fit_vocabulary
from pricemill.operators.throttle import Refused, Throttle, fetch_throttled
from pricemill.operators.validation import check_submission, evaluate_submission
from pricemill.sources.csv import headers, read_csv, read_products, read_submission, write_csv
from pricemill.sources.files import list_files, read_chunks, write_chunks
from pricemill.sources.quarantine import read_csv_marked, read_csv_quarantined
from pricemill.sources.staging import released_after

# Functions of this package reach the Python workers by value, so executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ArrowStore",
    "FolderStore",
    "LinearPrices",
    "PriceModel",
    "Refused",
    "TextVocabulary",
    "Throttle",
    "assign_chunks",
    "batch_predictor",
    "check_submission",
    "chunk_counts",
    "clean",
    "cross_validate",
    "ensemble",
    "error_by_segment",
    "error_metrics",
    "evaluate_submission",
    "exact_quantiles",
    "fetch_images",
    "fetch_throttled",
    "fit_price_model",
    "fit_vocabulary",
    "flag_outliers",
    "grouped_holdout",
    "hash_predictor",
    "hash_price",
    "headers",
    "image_manifest",
    "in_holdout",
    "in_sample",
    "leaderboard",
    "leaderboard_bootstrap",
    "leaks",
    "link_basename",
    "list_files",
    "merge_profiles",
    "nth_values",
    "pack_quantity",
    "pending_images",
    "predict",
    "price_band",
    "price_fences",
    "product_groups",
    "profile",
    "public_score",
    "read_chunks",
    "read_csv",
    "read_csv_marked",
    "read_csv_quarantined",
    "read_indexed_csv",
    "read_products",
    "read_profile",
    "read_submission",
    "released_after",
    "row_index",
    "row_predictor",
    "sample_exact",
    "score_submissions",
    "seeded_digest",
    "sketch_profile",
    "smape",
    "stack_weights",
    "stacked",
    "target_path",
    "text_features",
    "unit_hash",
    "with_chunk",
    "write_chunks",
    "write_csv",
    "write_profile",
]
