"""Statistical-fit result files as tables.

Every reader is ``read.text`` (split like any text scan) followed by a parser
that works on a table of ``value`` lines and ``path``, so lines from elsewhere
can be parsed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.fit_keys import file_stem, fit_key, workspace

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
# A failed fit writes nan or inf: such values are kept.
_VALUE = rf"(?:{_NUMBER}|[-+]?(?:[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?))"
# A name that is no number and no gamma parameter, then three numbers.
_FIT_LINE = rf"^\s*(?!{_NUMBER}\s|gamma)\S+(?:\s+{_VALUE}){{3}}\s*$"


def read_lines(spark: SparkSession, paths, pattern: str = "*") -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(paths)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )


def _words(lines: DataFrame) -> DataFrame:
    """Add the words of each line as an array. (Unlike a split, this compiles its pattern once, not once per line.)"""
    return lines.withColumn("_w", F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)))


def _split(lines: DataFrame, n: int) -> DataFrame:
    """Lines of exactly ``n`` words, with the words as an array: each line is split once."""
    return _words(lines).filter(F.size("_w") == n)


def _word(i: int) -> Column:
    return F.element_at("_w", i)


def _value(text: Column) -> Column:
    """A number as double; ``nan`` may have a sign, which only is looked for where the plain cast fails."""
    return F.coalesce(text.try_cast("double"), F.regexp_replace(text, "^[-+](?=[nN])", "").cast("double"))


def parse_fit_params(lines: DataFrame) -> DataFrame:
    """``fit`` (workspace and file, as one key), ``name, central, sig_hi, sig_lo`` of each ``name central up down`` line.

    Headers, the correlation matrix and the closing lines do not have this
    shape, hence no line order is needed and a file may be split. ``gamma*``
    lines are skipped; values that are ``nan`` or ``inf`` stay.
    """
    # The pattern leaves lines of four words.
    return _words(lines.filter(F.col("value").rlike(_FIT_LINE))).select(
        fit_key(F.col("path")).alias("fit"),
        _word(1).alias("name"),
        *[_value(_word(i)).alias(c) for i, c in enumerate(("central", "sig_hi", "sig_lo"), 2)],
    )


def read_fit_params(spark: SparkSession, paths) -> DataFrame:
    return parse_fit_params(read_lines(spark, paths, "*.txt"))


def parse_np_ranking(lines: DataFrame) -> DataFrame:
    """``fit`` (the workspace folder), ``name central sig_up sig_down post_up post_down pre_up pre_down``, rounded to 6 digits."""
    order = ["central", "sig_hi", "sig_lo", "post_up", "post_down", "pre_up", "pre_down"]
    return _split(lines, 8).select(
        workspace(F.col("path")).alias("fit"),
        F.regexp_replace(file_stem(F.col("path")), "^NPRanking_", "").alias("name"),
        *[F.bround(_value(_word(i)), 6).alias(c) for i, c in enumerate(order, 2)],
    )


def read_np_ranking(spark: SparkSession, paths) -> DataFrame:
    return parse_np_ranking(read_lines(spark, paths, "NPRanking_*.txt"))


def clean_group_name(name: Column) -> Column:
    return F.replace(F.when(name == "Gammas", F.lit("Statistics")).otherwise(name), F.lit("_"), F.lit(" "))


def parse_grouped_impacts(lines: DataFrame, include_total: bool = False) -> DataFrame:
    """``fit`` (the workspace folder), ``name, avg, sig_lo, sig_hi`` of six-token lines such as ``Group 0.05 ( +0.05, -0.04 )``."""
    rows = _split(lines, 6)
    if not include_total:
        rows = rows.filter(_word(1) != "FullSyst")
    return rows.select(
        workspace(F.col("path")).alias("fit"),
        clean_group_name(_word(1)).alias("name"),
        _value(_word(2)).alias("avg"),
        _value(_word(5)).alias("sig_lo"),
        _value(F.regexp_replace(_word(4), ".$", "")).alias("sig_hi"),
    )


def read_grouped_impacts(spark: SparkSession, paths, include_total: bool = False) -> DataFrame:
    return parse_grouped_impacts(read_lines(spark, paths, "GroupedImpact.txt"), include_total)


def parse_chi2(lines: DataFrame) -> DataFrame:
    """``fit`` (the workspace folder), ``region, stage, chi2, ndof, probability`` from the ``key: value`` lines of ``{region}_{stage}Fit_Chi2.txt``."""
    named = r"([^/]+)_(pre|post)Fit_Chi2\.txt$"
    pair = r"^\s*(chi2|ndof|probability)\s*:\s*(\S+)\s*$"
    rows = lines.filter(F.col("path").rlike(named) & F.col("value").rlike(pair)).select(
        workspace(F.col("path")).alias("fit"),
        F.regexp_extract("path", named, 1).alias("region"),
        F.regexp_extract("path", named, 2).alias("stage"),
        F.regexp_extract("value", pair, 1).alias("_k"),
        _value(F.regexp_extract("value", pair, 2)).alias("_v"),
    )

    def of(key):
        return F.max(F.when(F.col("_k") == key, F.col("_v")))

    return rows.groupBy("fit", "region", "stage").agg(
        of("chi2").alias("chi2"), of("ndof").cast("int").alias("ndof"), of("probability").alias("probability")
    )


def read_chi2(spark: SparkSession, paths) -> DataFrame:
    return parse_chi2(read_lines(spark, paths, "*_Chi2.txt"))


def fit_inventory(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """``fit`` (the workspace folder), ``region, has_postfit`` of a file listing: regions with a pre-fit file (no Asimov),
    and whether any file of the region is post-fit."""
    file = F.col(name)
    return (
        files.filter(file.rlike(r"_(pre|post)Fit\.root$") & ~F.contains(file, F.lit("asimov")))
        .select(workspace(F.col(path)).alias("fit"), F.regexp_extract(file, r"^(.*)_(pre|post)Fit\.root$", 1).alias("region"), file.alias("_f"))
        .groupBy("fit", "region")
        .agg(
            F.max(F.contains(F.col("_f"), F.lit("preFit"))).alias("_pre"),
            F.max(F.contains(F.col("_f"), F.lit("postFit"))).alias("has_postfit"),
        )
        .filter("_pre")
        .drop("_pre")
    )


def postfit_available(files: DataFrame, name: str = "name") -> DataFrame:
    """One row: does any file name contain ``postFit``?"""
    return files.agg(F.coalesce(F.max(F.contains(F.col(name), F.lit("postFit"))), F.lit(False)).alias("postfit"))
