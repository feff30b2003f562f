"""Sources and sinks: contract-checked tables from files or databases, and versioned snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def conformed(raw: DataFrame, contract: Mapping[str, str], mapping: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The contract's columns with its types: source names mapped, bad numbers null, defaults for null; a missing column is an error."""
    mapping, defaults = mapping or {}, defaults or {}
    missing = [c for c in contract if mapping.get(c, c) not in raw.columns and c not in defaults]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = []
    for c, kind in contract.items():
        source = F.col(f"`{mapping.get(c, c)}`").try_cast(kind) if mapping.get(c, c) in raw.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(source, F.lit(defaults[c]).cast(kind)) if c in defaults else source).alias(c))
    return raw.select(*out)


def csv_table(spark: SparkSession, path: str, contract: Mapping[str, str], **options) -> DataFrame:
    """A CSV file with a header line, as its contract says."""
    return conformed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), contract, **options)


def jdbc_table(spark: SparkSession, url: str, table: str, contract: Mapping[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, properties: Mapping[str, str] | None = None, **options) -> DataFrame:
    """A database table, read in ranges of a numeric key at once; selections and filters go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(properties or {}))
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return conformed(reader.load(), contract, **options)


def within_history(df: DataFrame, as_of: Column, days: int, time_col: str = "created_at") -> DataFrame:
    """Rows of the last days before ``as_of``."""
    if not 1 <= days <= 3650:
        raise ValueError("history is 1 to 3650 days")
    return df.where(F.col(time_col) >= as_of - F.make_dt_interval(F.lit(days)))


def with_text(df: DataFrame, column: str, active: str | None = None) -> DataFrame:
    """Rows whose text is not blank and, if a flag is named, that are active."""
    kept = df.where(F.trim(column) != "")
    return kept.where(F.col(active) == 1) if active else kept


def _manifest(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> str:
    """Write a new version of all tables, then name it in the manifest; a failure leaves the old one named.

    Readers see all of a version or none: the manifest is replaced by a rename within its store.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/version={version}/{name}")
    fs, path = _manifest(spark, root)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest-{version}.json")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE
    context.rename(fresh, path, kinds)
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that the manifest names."""
    fs, path = _manifest(spark, root)
    version = json.loads(spark.read.option("wholetext", True).text(path.toString()).first()[0])["version"]
    return spark.read.parquet(f"{root}/version={version}/{name}")
