"""Where datasets of each stage live, and how results are named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.sources.readers import list_datasets

# The zones and the order in which a name is looked up.
ZONES = ["ingredients", "dishes", "salad", "edits", "oven", "latex_library"]
LOOKUP_ORDER = ["ingredients", "dishes", "salad", "edits"]


@dataclass(frozen=True)
class Zones:
    root: str

    def path(self, zone: str, name: str = "") -> str:
        if zone not in ZONES:
            raise ValueError(f"unknown zone {zone!r}")
        return f"{self.root.rstrip('/')}/{zone}" + (f"/{name}" if name else "")

    def datasets(self, spark: SparkSession) -> DataFrame:
        """All datasets as (zone, dataset, files, bytes, modified)."""
        found = []
        for zone in ZONES:
            kinds = {"extensions": [".tex"]} if zone == "latex_library" else {}
            listed = list_datasets(spark, self.path(zone), **kinds)
            found.append(listed.select(F.lit(zone).alias("zone"), *listed.columns))
        return reduce(DataFrame.unionByName, found)

    def locate(self, spark: SparkSession, name: str) -> str:
        """Path of a dataset: the first zone that has it; ``edits/x`` looks only there."""
        order = LOOKUP_ORDER
        if name.startswith("edits/"):
            order, name = ["edits"], name.removeprefix("edits/")
        for zone in order:
            listed = list_datasets(spark, self.path(zone))
            if listed.filter(F.col("dataset") == name).take(1):
                return self.path(zone, name)
        raise FileNotFoundError(f"{name} is in none of {', '.join(order)}")


def stem(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base


def synthetic_name(name: str, epoch_seconds: int) -> str:
    return f"{stem(name)}_synthetic_{epoch_seconds}.parquet"


def sliced_name(name: str) -> str:
    return f"{stem(name)}_sliced.parquet"


def edited_name(name: str) -> str:
    return f"{stem(name)}_edited.parquet"


def paraphrased_name(name: str, copy_no: int) -> str:
    return f"{stem(name)}_paraphrased_{copy_no}.txt"


def combined_name(names: Sequence[str]) -> str:
    kinds = {n[n.rfind("."):] for n in names}
    if len(names) < 2 or len(kinds) > 1:
        raise ValueError("at least two files of one type are needed")
    return "_".join(stem(n) for n in names) + kinds.pop()
