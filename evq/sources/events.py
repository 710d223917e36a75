"""Event tables: reading, classifying files by name, and writing prepared samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq import config
from evq.functions.regions import by_name
from evq.functions.selections import selection_for
from evq.operators.frames import (
    WEIGHT,
    apply_weight_campaign,
    drop_avoid,
    drop_columns,
    drop_jet2,
    nan_to_null,
    select_events,
    selection_column,
)

CAMPAIGNS = ("MC16a", "MC16d", "MC16e")


def read_events(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    weight_name: str = WEIGHT,
    drop_weight_sys: bool = False,
    file_name: bool = False,
    **options,
) -> DataFrame:
    """The requested columns and the weight, sorted by name without regard to case.

    The schema comes from the first file (no merging), the scan reads only the
    selected columns. ``file_name`` adds the name of the file each row is from.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.options(**options).parquet(*paths)
    wanted = set(df.columns if columns is None else columns) | {weight_name}
    missing = by_name(wanted - set(df.columns))
    if missing:
        raise ValueError(f"columns not in the files: {', '.join(missing)}")
    if drop_weight_sys:
        wanted = {c for c in wanted if not c.startswith("weight_sys")}
    extra = [F.col("_metadata.file_name").alias("file_name")] if file_name else []
    return df.select(*by_name(wanted), *extra)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, name`` of the files below a folder, empty ones included.

    This is the listing Spark's file index holds on the driver for any read of
    the folder; no file is opened.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .inputFiles()
    )
    files = spark.createDataFrame([(f,) for f in listing], "path string")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


# --- file names -----------------------------------------------------------------

_SAMPLE = r"^(\w+)_([0-9]{6})_(FS|AFII)_(MC16[ade])_(\w+)(\.\w+|$)"


def sample_info(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``phy_process, dsid, sim_type, campaign, tree, is_valid`` parsed from a file name."""
    file = F.col(name)
    data = F.contains(file, F.lit("Data_Data"))
    valid = F.regexp_like(file, F.lit(_SAMPLE))

    def part(group: int) -> Column:
        return F.when(valid, F.regexp_extract(file, _SAMPLE, group))

    process = F.when(part(1).startswith("MCNP"), F.lit("MCNP")).otherwise(part(1))
    fixed = F.lit("Data")
    return df.withColumns(
        {
            "phy_process": F.when(data, fixed).otherwise(process),
            "dsid": F.when(data, F.lit(0)).otherwise(part(2).cast("int")),
            "sim_type": F.when(data, fixed).otherwise(part(3)),
            "campaign": F.when(data, fixed).otherwise(part(4)),
            "tree": F.when(data, F.lit("nominal")).otherwise(part(5)),
            "is_valid": data | valid,
        }
    )


def require_valid(df: DataFrame, name: str = "name") -> DataFrame:
    """Fail, when the rows are read, on the first file name that could not be parsed."""
    message = F.concat(F.col(name), F.lit(" is not a sample file name"))
    return df.withColumn(
        "is_valid", F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def sample_group(
    df: DataFrame, name: str = "name", campaign: str | None = None, tree: str = "nominal"
) -> DataFrame:
    """Add ``sample_group``; null for a file of no group (or of another campaign)."""
    if campaign is not None and campaign not in CAMPAIGNS:
        raise ValueError(f"campaign must be one of {', '.join(CAMPAIGNS)}, not {campaign}")
    file = F.col(name)
    letters = "(a|d|e)" if campaign is None else campaign[-1]
    group = F.lit(None).cast("string")
    for label, (process, dsid, sim) in config.SAMPLE_GROUPS.items():
        group = F.when(file.rlike(f"^{process}_({dsid})_{sim}_MC16{letters}_{tree}.root$"), F.lit(label)).otherwise(group)
    years = config.DATA_YEARS[campaign]
    data = file.rlike(f"^Data1({years})_data1({years})_Data_Data_{tree}.root$")
    return df.withColumn("sample_group", F.when(data, F.lit("Data")).otherwise(group))


def sample_files(
    spark: SparkSession, path: str, campaign: str | None = None, tree: str = "nominal"
) -> dict[str, list[str]]:
    """Group name to sorted file paths, for :func:`read_events`."""
    found: dict[str, list[str]] = {group: [] for group in (*config.SAMPLE_GROUPS, "Data")}
    rows = sample_group(list_files(spark, path), campaign=campaign, tree=tree).filter("sample_group IS NOT NULL")
    for row in rows.select("sample_group", "path").toLocalIterator():
        found[row["sample_group"]].append(row["path"])
    return {group: sorted(paths) for group, paths in found.items()}


# --- sinks ----------------------------------------------------------------------


def region_sample(
    df: DataFrame, region: str, use_campaign_weight: bool = False, key: str | None = None
) -> DataFrame:
    """Columns and rows of one region's sample."""
    selected = select_events(
        df,
        selection_for(region),
        keep_category="kinematics",
        use_campaign_weight=use_campaign_weight,
        key=key,
    )
    selected = drop_avoid(drop_columns(selected, *config.ALWAYS_DROP[region]), region)
    return drop_jet2(selected) if region == "1j1b" else selected


def write_region_samples(
    df: DataFrame,
    path: str,
    samples: Sequence[str] = ("tW_DR", "tW_DS", "ttbar"),
    group: str = "sample_group",
    use_campaign_weight: bool = False,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """Write ``{path}/region={region}/{group}={sample}`` of all regions in one write from one scan.

    Regions have different columns: the table holds all of them, null where a region has none, and ``_columns``
    beside it says which belong to a region (:func:`read_region_sample` restores them). An event of several regions
    is written in each. Rows are rebalanced by region and sample first: Spark splits large samples and merges small
    parts, so the number of files follows the data and not tasks times samples.
    """
    root, chosen = path.rstrip("/"), df.filter(F.col(group).isin(*samples))
    columns = {region: region_sample(chosen, region, use_campaign_weight, key=group).columns for region in config.SELECTIONS}
    every = by_name({c for names in columns.values() for c in names})
    if "region" in every:
        raise ValueError("the table has a column named region already")
    weighted = apply_weight_campaign(chosen) if use_campaign_weight else chosen
    inside = F.array(*[F.when(selection_column(weighted, selection_for(region)), F.lit(region)) for region in columns])
    rows = nan_to_null(weighted.withColumn("region", F.explode(F.array_compact(inside))).select("region", *every))
    own = {c: [region for region, names in columns.items() if c in names] for c in every}
    rows = rows.withColumns({c: F.when(F.col("region").isin(*regions), F.col(c)) for c, regions in own.items() if len(regions) < len(columns)})
    rows.hint("rebalance", "region", group).write.mode(mode).partitionBy("region", group).parquet(root)
    listed = [(region, i, c) for region, names in columns.items() for i, c in enumerate(names)]
    df.sparkSession.createDataFrame(listed, "region string, position int, name string").coalesce(1).write.mode(mode).json(f"{root}/_columns")
    return {region: f"{root}/region={region}" for region in columns}


def read_region_sample(spark: SparkSession, path: str, region: str) -> DataFrame:
    """One region of :func:`write_region_samples`, with that region's columns. Only its files are read."""
    root = path.rstrip("/")
    # The names of one region's columns, a few hundred.
    names = {(r["position"], r["name"]) for r in spark.read.json(f"{root}/_columns").filter(F.col("region") == region).collect()}
    if not names:
        raise ValueError(f"no region {region} in {path}")
    return spark.read.parquet(root).filter(F.col("region") == region).select(*[name for _, name in sorted(names)])


def save_prepared(
    df: DataFrame,
    path: str,
    selection: str,
    region: str,
    nlo_method: str = "DR",
    signal_files: Sequence[str] = (),
    background_files: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """A prepared training table and a one-row table that says how it was made."""
    root = path.rstrip("/")
    df.write.mode(mode).parquet(f"{root}/events")
    df.sparkSession.createDataFrame(
        [(selection, region, nlo_method, list(signal_files), list(background_files))],
        "selection_used string, region string, nlo_method string, signal_files array<string>, "
        "background_files array<string>",
    ).coalesce(1).write.mode(mode).parquet(f"{root}/about")


def load_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, Mapping]:
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/events"), spark.read.parquet(f"{root}/about").first().asDict()
