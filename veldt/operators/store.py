"""A keyed, append-only table with enforced uniqueness.

Writes are versioned: version ``n`` adds the rows whose keys no lower version
holds, into its own folders, and replaces only those, so a write that was
killed and repeated changes nothing twice.  Two writers that did not see each
other's rows are settled on reading: of one key the lowest version counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.operators import merge as M


class KeyedStore:
    """``keys`` are unique; ``by`` (one of them, or a column that they decide) names the folders."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], by: str):
        self.spark, self.path, self.keys, self.by = spark, path, list(keys), by
        self.schema = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("version", T.LongType())])

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)  # nothing written yet; any other error of a read is raised
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        """One row per key: the lowest version's."""
        w = Window.partitionBy(*self.keys).orderBy("version")
        return self._rows().withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "version")

    def write(self, rows: DataFrame, version: int) -> None:
        """Add the rows whose keys are not held yet (of rows that share a key, the first by :func:`merge.first_by`);
        only the folders of the rows' ``by`` values are looked up."""
        own = [f.name for f in self.schema.fields if f.name != "version"]
        rows = rows.select(*own)
        touched = rows.select(self.by).distinct()
        held = self._rows().where(F.col("version") < version).join(touched, self.by, "left_semi")
        (M.insert_if_absent(held, rows, self.keys).withColumn("version", F.lit(version).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by, "version").parquet(self.path))


HEADER = ("recommendation_id string, entity string, scenario_id string, budget decimal(12,2), total_cost decimal(12,2), "
          "total_risk_reduction decimal(8,6), created_at timestamp_ntz")
LINE = ("recommendation_id string, intervention_id string, zone_id string, entity string, units int, total_cost decimal(12,2)")


def recommendation_stores(spark: SparkSession, base: str) -> tuple[KeyedStore, KeyedStore]:
    """Headers, unique by id, and allocation lines, unique by (recommendation, intervention, zone)."""
    return (KeyedStore(spark, f"{base}/recommendations", HEADER, ["recommendation_id"], "entity"),
            KeyedStore(spark, f"{base}/allocations", LINE, ["recommendation_id", "intervention_id", "zone_id"], "entity"))


def history(headers: KeyedStore, limit: int = 20) -> DataFrame:
    """Newest recommendations of every entity, ``limit`` (1 to 100) at most, with their place from 1 (F2)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    w = Window.partitionBy("entity").orderBy(F.col("created_at").desc(), "recommendation_id")
    return headers.read().withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
