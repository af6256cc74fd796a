"""Options of the preprocess job."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from quillshard.operators.positions import ROWS_PER_PART


@dataclass(frozen=True)
class PreprocessConfig:
    """What to read, how to split and shard it, and where to write.

    ``key`` names the columns whose values are unique per row; they define the stored order, which
    Spark tables do not have by themselves.
    """

    path: str
    key: tuple[str, ...]
    output_dir: str | None = None
    fmt: str = "parquet"
    split: str | None = "train"
    subset: str | None = None
    val_subset: str | None = None
    subset_column: str = "subset"
    split_column: str = "split"
    # a DDL schema spares JSON and CSV inputs a pass that infers one
    schema: str | None = None
    options: Mapping[str, str] | None = None
    train_max_examples: int | None = None
    val_max_examples: int | None = None
    max_length: int = 512
    num_train_shards: int = 1
    num_val_shards: int = 0
    val_split_ratio: float = 0.0
    mask_padding: bool = False
    seed: int = 42
    keep_position: bool = False
    keep_stale: bool = False
    # store a new version beside the ones that readers hold, instead of replacing shards
    snapshots: bool = False
    rows_per_part: int = ROWS_PER_PART

    @classmethod
    def from_mapping(cls, cfg: Mapping[str, Any]) -> PreprocessConfig:
        """From the nested run configuration (``dataset``, ``model`` and ``preprocess`` sections).

        A subset under ``preprocess`` wins over the one under ``dataset``. The only ratio that counts
        is the one under ``preprocess``.
        """
        dataset, job = cfg["dataset"], cfg["preprocess"]
        train, val = job["train"], job["val"]
        chosen = lambda first, second: first if first is not None else second
        own = {k: dataset[k] for k in ("fmt", "subset_column", "split_column", "schema", "options") if k in dataset}
        more = {k: job[k] for k in ("mask_padding", "seed", "keep_position", "keep_stale", "snapshots", "rows_per_part") if k in job}
        return cls(
            path=dataset["name"],
            key=tuple(dataset["key"]),
            output_dir=job["output_dir"],
            split=dataset["split"],
            subset=chosen(train.get("subset"), dataset.get("subset")),
            val_subset=chosen(val.get("subset"), dataset.get("val_subset")),
            train_max_examples=train.get("max_examples"),
            val_max_examples=val.get("max_examples"),
            max_length=cfg["model"]["max_length"],
            num_train_shards=train["num_shards"],
            num_val_shards=val["num_shards"],
            val_split_ratio=job["val_split_ratio"],
            **own,
            **more,
        )
