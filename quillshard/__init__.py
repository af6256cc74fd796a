"""Supervised fine-tuning data preparation and run telemetry on Spark DataFrames."""

from quillshard.plans.config import PreprocessConfig
from quillshard.plans.preprocess import preprocess, tokenized_examples

__all__ = ["PreprocessConfig", "preprocess", "tokenized_examples"]
