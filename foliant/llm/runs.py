"""Levelled runs: an index of 128-bit keys as immutable tables, bucketed and sorted by key, each key in one run only.

A run of level 0 comes from one batch. As soon as `fanout` runs of a level have gathered, the next batch finds them merged
to one run of the level above, so that a batch is compared with few runs and a key is rewritten once a level.
A run's buckets hold one file each; batch and runs are joined bucket by bucket, without a shuffle of the runs.

Lists beside the runs say which of them count, at which level; the one with the greatest number holds. It is written once a run is
complete, so a write that fails leaves the index as it was, and the index can be opened again from its path in another session.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import created, delete, named, names, read_text, workspace, write_text

KEY = ("h1", "h2")


class Runs:
    """Keys h1, h2 with the columns that are stored beside them.

    path: where the index lies or shall lie; without one it is in a workspace, and goes with it. fanout and buckets hold for a
    new index; one that is there keeps its own, until rebucket(). Without a number, a new one has as many buckets as the session has shuffle
    partitions.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path = spark, path or workspace(spark, "runs")
        self.passing = any(f"{self.path}/".startswith(f"{p}/") for p in created())
        lists = [n for n in names(spark, self.path) if re.fullmatch(r"levels-\d+\.json", n)]
        told = json.loads(read_text(spark, f"{self.path}/{lists[-1]}")) if lists else {}
        self.state = int(lists[-1][7:-5]) if lists else 0
        self.fanout = told.get("fanout", fanout)
        self.buckets = told.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = told.get("levels", [[]])
        self.schema: str | None = told.get("schema")
        for name in self.tables():
            if not spark.catalog.tableExists(name):
                key = ", ".join(KEY)
                spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        name = f"foliant_run_{uuid.uuid4().hex}"
        if self.passing:
            named(self.spark, name)
        df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.schema = self.schema or ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
        return name

    def _become(self, levels: list[list[str]]) -> None:
        self.levels, self.state = levels, self.state + 1
        write_text(self.spark, f"{self.path}/levels-{self.state:09d}.json", json.dumps({"fanout": self.fanout, "buckets": self.buckets, "schema": self.schema, "levels": levels}))
        delete(self.spark, f"{self.path}/levels-{self.state - 2:09d}.json")

    def new(self, batch: DataFrame) -> DataFrame:
        """Rows of batch, one a key, whose key no run has: one merge anti-join a run."""
        for name in self.tables():
            batch = batch.join(self.spark.table(name).select(*KEY).hint("merge"), list(KEY), "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Appends what new() gives for a batch with one row a key, after merging the levels that are full."""
        self.compact()
        self._become([[*self.levels[0], self._write(self.new(batch))], *self.levels[1:]])

    def compact(self) -> None:
        """Merges the runs of each level that has `fanout` of them to one of the next level."""
        level = 0
        while level < len(self.levels):
            if len(full := self.levels[level]) >= self.fanout:
                merged = self.spark.table(full[0])
                for name in full[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                run = self._write(merged.repartition(self.buckets, *KEY))
                above = self.levels[level + 1] if level + 1 < len(self.levels) else []
                self._become([*self.levels[:level], [], [*above, run], *self.levels[level + 2 :]])
                for name in full:
                    self.spark.sql(f"DROP TABLE {name}")
                    delete(self.spark, f"{self.path}/{name}")
            level += 1

    def rebucket(self, buckets: int) -> None:
        """Rewrites all runs as one with so many buckets, for an index that has outgrown its own number."""
        before, merged = self.tables(), self.all() if self.tables() else None
        self.buckets = buckets
        self._become([*[[] for _ in self.levels[:-1]], [self._write(merged.repartition(buckets, *KEY))]] if before else self.levels)
        for name in before:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.path}/{name}")

    def all(self) -> DataFrame:
        """All keys, each once."""
        first, *rest = [self.spark.table(t) for t in self.tables()]
        for df in rest:
            first = first.unionByName(df)
        return first
