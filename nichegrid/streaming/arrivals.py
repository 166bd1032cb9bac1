"""Samples that arrive over time: networks and mixing statistics of each batch of new files.

Samples are independent in these steps, so that each micro-batch is a small cohort; a sample's file must arrive whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nichegrid.operators import mixing
from nichegrid.plans.config import NetworkConfig
from nichegrid.plans.steps import networks


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of nodes (patient, sample, node_id, x, y, phenotype) from Parquet files that appear in a folder."""
    schema = "patient string, sample string, node_id long, x double, y double, phenotype string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def follow(nodes: DataFrame, out: str, checkpoint: str, config: NetworkConfig = NetworkConfig()) -> StreamingQuery:  # noqa: B008
    """Writes edges and assortativity of every new sample under out/edges and out/assortativity, a folder for each batch.

    A batch that is repeated after a failure overwrites its own folders. The query ends when all files are done.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = f"batch={number}"
        df.write.mode("overwrite").parquet(f"{out}/nodes/{own}")
        rows = spark.read.parquet(f"{out}/nodes/{own}")
        if rows.isEmpty():
            return
        networks(rows, config).write.mode("overwrite").parquet(f"{out}/edges/{own}")
        edges = spark.read.parquet(f"{out}/edges/{own}")
        mixing.assortativity(edges, rows).withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/assortativity/{own}")

    return nodes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
