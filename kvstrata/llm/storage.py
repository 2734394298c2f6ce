"""Where operators cut lineage: Parquet tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from kvstrata.sources.shipping import hadoop_path, passing_folder, ship_package

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that are taken (in any case of letters)."""
    taken = {t.lower() for t in taken}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Shuffle files of the queries run inside go as each query ends: their results are tables by then."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one operator call. keep() writes one and returns it as read back; drop() removes those no longer read, and
    what is left goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.at, self.n = spark, passing_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n:03d}"
        with freeing_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def keep_bucketed(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """Writes the frame in buckets by a column: what groups or joins by it afterwards doesn't exchange it again."""
        self.n += 1
        path, name = f"{self.at}/{self.n:03d}", f"kvstrata_{uuid.uuid4().hex}"
        with freeing_shuffles(self.spark):
            df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # noqa: B018  the frame is resolved now; its files outlive the name
        self.spark.sql(f"DROP TABLE {name}")
        out.kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, files = hadoop_path(self.spark, t.kept_at)
            files.delete(path, True)
