"""Region names, and the column-name rules that depend on a region."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import config

_WEIGHT_NAME = re.compile(r"^weight_\w+|\w+_weight$")


class Region(Enum):
    r1j1b = 0
    r2j1b = 1
    r2j2b = 2
    rUnkn = 9

    def __str__(self) -> str:
        return self.name[1:]


def as_region(region: str | Region) -> Region:
    """``"2j2b"``, ``"r2j2b"``, ``"reg2j2b"`` or a :class:`Region`."""
    if isinstance(region, Region):
        return region
    bare = re.sub(r"^(reg|r)", "", region)
    try:
        return Region[f"r{bare}"]
    except KeyError:
        raise ValueError(f"{region} is not a region") from None


def analysis_region(region: str | Region) -> str:
    """Bare name of one of the three analysis regions; an error for any other."""
    name = str(as_region(region))
    if name not in config.SELECTIONS:
        raise ValueError(f"no selection, features or avoid list for region {region}")
    return name


def normalize_region(col: Column) -> Column:
    """The three spellings of a region name to the bare one; null for anything else."""
    bare = F.regexp_replace(col, "^(reg|r)", "")
    return F.when(bare.isin(*config.SELECTIONS), bare)


def region_label(columns: dict[str, str]) -> Column:
    """Region of each event from its ``reg*`` flags; null when no flag is set."""
    label = F.lit(None).cast("string")
    for name in reversed(list(config.SELECTIONS)):
        flag = f"reg{name}"
        if flag in columns:
            label = F.when(F.col(flag).cast("boolean"), F.lit(name)).otherwise(label)
    return label


def by_name(names) -> list[str]:
    return sorted(names, key=str.lower)


def avoids_for(region: str | Region) -> list[str]:
    return list(config.AVOID_BY_REGION[analysis_region(region)])


def features_for(region: str | Region) -> list[str]:
    """Feature list of a region; ``"ALL"`` is the union over the three regions."""
    if region == "ALL":
        return by_name({f for features in config.FEATURES.values() for f in features})
    return by_name(config.FEATURES[analysis_region(region)])


def categorize_columns(names) -> dict[str, list[str]]:
    """Split column names into the disjoint ``kinematics``, ``weights`` and ``meta``."""
    names = set(names)
    meta = names & set(config.META_COLUMNS)
    weights = {n for n in names if _WEIGHT_NAME.match(n)} - meta
    return {
        "kinematics": by_name(names - meta - weights),
        "weights": by_name(weights),
        "meta": by_name(meta),
    }


def columns_from(df, ignore_weights: bool = False) -> list[str]:
    """Column names in case-insensitive order, optionally without ``weight_*``."""
    return by_name(c for c in df.columns if not (ignore_weights and c.startswith("weight_")))


def default_parameters(region: str | Region) -> dict[str, float]:
    return dict(config.REGION_TUNES[analysis_region(region)])


def train_axes(**overrides) -> dict[str, float]:
    """Hyper-parameters with their defaults; names that are not an axis are ignored."""
    return {axis: overrides.get(axis, value) for axis, value in config.TRAIN_AXES.items()}
