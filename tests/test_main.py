import json

import pytest
from pyspark.sql import functions as F

from catalog.queries import byte_level_tokenizer
from quillshard.__main__ import main, override
from quillshard.sources.shards import load_shard_for_rank, read_manifest


@pytest.mark.parametrize("encoder", [{"class": "quillshard.functions.encoders.ByteEncoder"}, {"tokenizer_file": None, "eos_token": "<eos>"}])
def test_job_from_a_configuration_file(spark, folder, encoder, capsys):
    spark.range(30).select(F.col("id").alias("k"), F.col("id").cast("string").alias("q"), F.lit("a").alias("a")).write.parquet(f"{folder}/in")
    if "tokenizer_file" in encoder:
        encoder = {**encoder, "tokenizer_file": f"{folder}/tokenizer.json"}
        with open(encoder["tokenizer_file"], "w") as f:
            f.write(byte_level_tokenizer())
    config = {
        "dataset": {"name": f"{folder}/in", "key": ["k"], "split": "train", "subset": None},
        "formatter": {"class": "quillshard.functions.formatting.InstructionFormatter", "instruction_field": "q", "target_field": "a"},
        "encoder": encoder,
        "model": {"max_length": 32},
        "preprocess": {"output_dir": f"{folder}/out", "train": {"num_shards": 1}, "val": {"num_shards": 1}, "val_split_ratio": 0.1},
    }
    with open(f"{folder}/config.json", "w") as f:
        json.dump(config, f)
    main([f"{folder}/config.json", "preprocess.train.num_shards=3", "preprocess.train.max_examples=20"])
    assert {r.shard_name: r.num_rows for r in read_manifest(spark, f"{folder}/out").collect()} == {"shard_0": 6, "shard_1": 6, "shard_2": 6, "val_shard_0": 2}
    assert "val_shard_0" in capsys.readouterr().out
    row = load_shard_for_rank(spark, f"{folder}/out", "shard_{rank}", 2, 3).first()
    assert len(row.input_ids) == len(row.labels) == 32
    with pytest.raises(ValueError, match="mode"):
        main([f"{folder}/config.json", "mode=serve"])


def test_overrides():
    assert override({"a": {"b": 1}}, ["a.b=2", "a.c=x", "d.e=null", "f=0.5"]) == {"a": {"b": 2, "c": "x"}, "d": {"e": None}, "f": 0.5}
    with pytest.raises(ValueError):
        override({}, ["a"])
