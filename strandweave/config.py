"""Run settings and their command-line form."""

from __future__ import annotations

import re
from dataclasses import dataclass

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def size_to_bytes(text: str) -> int:
    """`64`, `16k`, `32m`, `1g` (binary units, either case) to bytes."""
    m = re.fullmatch(r"(\d+)([kmg]?)", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


@dataclass
class Config:
    """`min_overlap` changes results. `split_bytes` and `task_bytes` become Spark settings; the two block sizes of the
    original command line have no counterpart and are accepted and ignored."""

    input: str = ""
    output: str = ""
    min_overlap: int = 31
    split_bytes: int = 1 << 30
    task_bytes: int = 1 << 30
    base_block: int = 32 << 20
    pair_block: int = 64 << 20
    format: str = "binary"
    wide_ids: bool = False
    all_overlaps: bool = False
    incomplete: str = "strict"
    reader: str = "ranges"

    def __post_init__(self):
        if self.min_overlap < 1:
            raise ValueError("the least overlap must be at least 1")

    @property
    def range_bytes(self) -> int:
        """Bytes of a file that one task reads."""
        return max(1 << 20, self.split_bytes // 8)

    def spark_settings(self) -> dict[str, str]:
        return {"spark.sql.files.maxPartitionBytes": str(self.range_bytes), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(1 << 20, self.task_bytes // 16)), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
