"""Repository of nested results, kept by kind and by session.

A kind (overlap, static, non_overlap, grouping, matching, constraints, solutions, or any other name) is one Parquet table.
Rows are stored under a digest of their keys, so any key text, a null or an empty one included, comes back as it was;
saving the rows of some sessions replaces these sessions and leaves the others."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = "key_digest"


def _place(keys: Sequence[str]):
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 24)


class Results:
    """``Results(spark, folder)``: save and load tables of results under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _schema(self, kind: str) -> tuple[StructType, list[str]]:
        row = self.spark.read.schema("body string").json(f"{self.folder}/schemas/{kind}").first()
        saved = json.loads(row["body"])
        return StructType.fromJson(saved["schema"]), saved["keys"]

    def kinds(self) -> list[str]:
        """Names saved so far."""
        rows = self.spark.read.schema("kind string").json(f"{self.folder}/schemas/*").select("kind").distinct().collect()
        return sorted(r["kind"] for r in rows)

    def save(self, kind: str, rows: DataFrame, keys: Sequence[str] = ("session",)) -> None:
        """Replace the rows of the keys that ``rows`` holds.  The schema of a kind is fixed by its first save."""
        body = json.dumps({"schema": json.loads(rows.schema.json()), "keys": list(keys)})
        try:
            known, own = self._schema(kind)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            self.spark.createDataFrame([(kind, body)], "kind string, body string").coalesce(1).write.json(f"{self.folder}/schemas/{kind}")
        else:
            if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in rows.schema] or own != list(keys):
                raise ValueError(f"{kind} was saved with other columns or keys")
        placed = rows.withColumn(PLACE, _place(keys))
        # the rows of a session meet in few files; a session of any size is written by many tasks
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PLACE).parquet(f"{self.folder}/tables/{kind}")

    def load(self, kind: str, sessions: DataFrame | None = None) -> DataFrame:
        """All rows of a kind, or those of the keys in ``sessions``; only their folders are read."""
        schema, keys = self._schema(kind)
        rows = self.spark.read.schema(StructType(list(schema)).add(PLACE, "string")).parquet(f"{self.folder}/tables/{kind}")
        if sessions is not None:
            rows = rows.join(sessions.select(_place(keys).alias(PLACE)).distinct(), PLACE, "left_semi")
        return rows.select(*schema.names)


def save_json(rows: DataFrame, path: str) -> None:
    """Nested rows as gzip JSON lines; nulls are written, so that they come back."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression="gzip")


def load_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows that :func:`save_json` wrote; a line that does not fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
