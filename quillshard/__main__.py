"""Job entry point: ``spark-submit`` or ``python -m quillshard CONFIG.json [section.key=value ...]``.

The configuration has the sections ``dataset``, ``model`` and ``preprocess`` of ``PreprocessConfig``,
plus ``formatter`` and ``encoder``. Each of those two names a ``class`` (``package.module.Class``) and
its arguments; an encoder may instead name a ``tokenizer_file``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from importlib import import_module
from typing import Any

from pyspark.sql import SparkSession

from quillshard.functions.encoders import Encoder, FileEncoder
from quillshard.plans.config import PreprocessConfig
from quillshard.plans.preprocess import preprocess


def override(config: dict[str, Any], assignments: Sequence[str]) -> dict[str, Any]:
    """Apply ``section.key=value`` assignments; a value is JSON where it parses, else text."""
    for assignment in assignments:
        path, given, text = assignment.partition("=")
        if not given:
            raise ValueError(f"'{assignment}' is not of the form section.key=value")
        *sections, key = path.split(".")
        node = config
        for section in sections:
            node = node.setdefault(section, {})
        try:
            node[key] = json.loads(text)
        except json.JSONDecodeError:
            node[key] = text
    return config


def build(section: dict[str, Any]) -> Any:
    """An instance of the class a configuration section names."""
    arguments = dict(section)
    module, _, name = arguments.pop("class").rpartition(".")
    return getattr(import_module(module), name)(**arguments)


def build_encoder(spark: SparkSession, section: dict[str, Any]) -> Encoder:
    if "tokenizer_file" not in section:
        return build(section)
    arguments = dict(section)
    content = spark.read.text(arguments.pop("tokenizer_file"), wholetext=True).first()[0]
    return FileEncoder(content, **arguments)


def main(argv: Sequence[str]) -> None:
    spark = SparkSession.builder.appName("quillshard").getOrCreate()
    config = override(json.loads(spark.read.text(argv[0], wholetext=True).first()[0]), argv[1:])
    mode = config.get("mode", "preprocess")
    if mode != "preprocess":
        raise ValueError(f"unknown mode '{mode}'")
    encoder = build_encoder(spark, config["encoder"])
    manifest = preprocess(spark, PreprocessConfig.from_mapping(config), build(config["formatter"]), encoder)
    ordered = manifest.orderBy("split", "shard_id")
    ordered.show(ordered.count(), truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
