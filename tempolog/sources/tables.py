"""Readers and writers of the stage tables, and what is recorded about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tempolog.operators.quality import ContractError

CORRUPT = "_corrupt"


def read_raw(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None, fmt: str = "csv") -> DataFrame:
    """A table with a header, every column as text. With a mapping, its source columns must exist."""
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    absent = sorted(set((mapping or {}).values()) - set(df.columns))
    if absent:
        raise ContractError(f"MISSING_INPUT_COLUMNS: {absent}")
    return df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", superset: bool = False, keep_corrupt: bool = False
) -> DataFrame:
    """A stage table whose columns must be exactly those of ``schema``, in order.

    With ``superset`` more columns are allowed, in any order. With ``keep_corrupt`` a CSV row with too many or
    too few cells is kept with its text in ``_corrupt`` instead of failing the read.
    """
    names = [f.name for f in schema.fields]
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
    else:
        header = spark.read.format(fmt).load(path).columns
    if (not set(names) <= set(header)) if superset else header != names:
        raise ContractError(f"header must {'contain' if superset else 'equal'} {names}; found {header}")
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    kinds = {f.name: f.dataType for f in schema.fields}
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    if keep_corrupt:
        full = full.add(CORRUPT, T.StringType())
        # The header has no corrupt column, so it is checked above and not again by the reader.
        reader = (spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False))
    else:
        reader = reader.option("mode", "FAILFAST")
    return reader.schema(full).csv(path).select(*names, *([CORRUPT] if keep_corrupt else []))


def write_stage(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", order: Sequence[str] = ()) -> None:
    """Write a stage table in its fixed column order; sorted across files only if an order is asked for."""
    out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        # Text as it is, quotes doubled as in RFC 4180, times with their zone.
        exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**exact).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    else:
        writer.format(fmt).save(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """One JSON object per change with sorted keys; columns that do not apply are left out."""
    audit.select(*sorted(audit.columns)).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file. A file is hashed as a whole, so it must be below two gigabytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row ``n, digest`` of a table, independent of row order, file layout and partitioning."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


# What the record of an evaluation must contain.
REQUIRED_METRICS = ("f1", "pr_auc", "roc_auc", "detection_delay", "thresholds")


def run_metadata(parts: Mapping[str, DataFrame], required: Sequence[str] = ()) -> DataFrame:
    """``section, item, value``: the small result tables of a run as one long table, to be written beside its output.

    Each part is a table; every row becomes one JSON value. ``required`` sections must be there.
    """
    missing = sorted(set(required) - set(parts))
    if missing:
        raise ContractError(f"metadata lacks {missing}")
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), F.col(f"`{df.columns[0]}`").cast("string").alias("item"),
                         F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
