"""The key of a fit: the folder of its workspace and the name of its result file, as one struct column.

Workspaces of different generator versions or years hold result files of equal names, so a name alone does not
identify a fit. Operators take the key as a ``FitKey``; where a table's ``fit`` is a plain string (one workspace),
they take a string.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FitKey(NamedTuple):
    workspace: str
    file: str

    def __str__(self) -> str:
        return f"{self.workspace}/{self.file}"


def _folder(path: Column) -> Column:
    """What lies above the last slash; empty without one."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def workspace(path: Column) -> Column:
    """The folder of the fit that a result file belongs to: what lies above ``Fits`` or ``Histograms``, else the file's folder."""
    folder = _folder(path)
    above = _folder(folder)
    return F.when(F.substring_index(folder, "/", -1).isin("Fits", "Histograms") & (above != ""), above).otherwise(folder)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z]+$", "")


def fit_key(path: Column) -> Column:
    return F.struct(workspace(path).alias("workspace"), file_stem(path).alias("file"))


def has_keys(df: DataFrame, fit: str = "fit") -> bool:
    return isinstance(df.schema[fit].dataType, T.StructType)


def is_fit(fit: str, which: str | FitKey) -> Column:
    """Whether a row belongs to the fit."""
    if isinstance(which, str):
        return F.col(fit) == which
    return (F.col(fit).getField("workspace") == which.workspace) & (F.col(fit).getField("file") == which.file)
