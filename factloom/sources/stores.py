"""Stores as folders of Parquet tables, with kind and version, replaced whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.verdict import Refusal

VERSIONS = {"Catalog": "2", "Image": "2", "Documents": "1", "Pseudocode": "1"}


def write(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> None:
    """A store at path: tables go to a fresh folder first, and the pointer file `current` names it last, so readers see the old store or the new one."""
    version = uuid.uuid4().hex
    own = {"Kind": kind, "SchemaVersion": VERSIONS[kind]} | (meta or {})
    for name, df in tables.items():
        sort = [c for c in ("image_id", "target", "address", "site", "file") if c in df.columns]
        (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(f"{path}/{version}/{name}")
    rows = list((tables["meta"].collect() if "meta" in tables else []))
    own = {r["key"]: r["value"] for r in rows} | own
    spark.createDataFrame(list(own.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/{version}/store-meta")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


class Store:
    """An opened store; a wrong kind or version is refused, and so is anything unreadable."""

    def __init__(self, spark: SparkSession, path: str, kind: str, **identity: str):
        self.spark = spark
        try:
            version = spark.read.text(f"{path}/current").first()
        except AnalysisException:
            raise Refusal("NotFound", "open store", path, "there is no store") from None
        if version is None:
            raise Refusal("Io", "open store", path, "its pointer is empty")
        self.path = f"{path}/{version[0]}"
        self.meta = {r["key"]: r["value"] for r in self.table("store-meta").collect()}
        for key, want in ({"Kind": kind, "SchemaVersion": VERSIONS[kind]} | identity).items():
            if self.meta.get(key) != want:
                raise Refusal("Mismatch", "open store", path, f"{key} is {self.meta.get(key)!r}, not {want!r}", "build the store again")

    def has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return False
        return True

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            raise Refusal("Io", "read table", f"{self.path}/{name}", str(e).split("\n")[0]) from None


def replace_image(df: DataFrame, path: str) -> None:
    """Rows of some images, written over those images' partitions alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(path)


def disk_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, from file metadata alone."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
