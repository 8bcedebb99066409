"""What a preparation has finished, kept next to its output.

A stage is a Parquet folder below ``<output>/_stages``; Spark's commit marker says that it is whole. The record
beside them names the settings and the fingerprint of the inputs that all stages come from, so a
stage is only ever read by a run that would write the same. A run that was killed goes on after its last
finished stage, and a finished preparation is read back without a look at its sources.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMIT = "_SUCCESS"  # fixed value: the marker of Spark's committers


class StageLedger:
    def __init__(self, spark: SparkSession, output: str, version: str) -> None:
        self.spark, self.output, self.version = spark, output.rstrip("/"), version

    # ---- files ------------------------------------------------------------------------------

    def _system(self, path: str):
        location = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), location

    def _exists(self, path: str) -> bool:
        system, location = self._system(path)
        return bool(system.exists(location))

    def _read(self, name: str) -> dict | None:
        path = f"{self.output}/_ledger/{name}"
        if not self._exists(f"{path}/{COMMIT}"):
            return None
        return json.loads(self.spark.read.text(path).first()["value"])

    def _write(self, name: str, value: Mapping) -> None:
        text = self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.output}/_ledger/{name}")

    # ---- the run ----------------------------------------------------------------------------

    def begin(self, fingerprint: str) -> bool:
        """Record what the output is made from. True when there was a record and it is the same.

        An output of other settings or inputs is refused: its stages are not this run's.
        """
        mine = {"version": self.version, "fingerprint": fingerprint}
        known = self._read("inputs")
        if known is None:
            self._write("inputs", mine)
            return False
        self._check(known)
        if known["fingerprint"] != fingerprint:
            raise ValueError(f"{self.output} was begun from other input files")
        return True

    def _check(self, known: Mapping) -> None:
        if known["version"] != self.version:
            raise ValueError(f"{self.output} was made with other settings")

    def done(self, name: str) -> bool:
        return self.whole(f"_stages/{name}")

    def whole(self, name: str) -> bool:
        """Whether a folder below the output was written to its end."""
        return self._exists(f"{self.output}/{name}/{COMMIT}")

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: built and written once, read from then on."""
        path = f"{self.output}/_stages/{name}"
        if not self.done(name):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    # ---- the end ----------------------------------------------------------------------------

    def finish(self, tables: Mapping[str, DataFrame]) -> None:
        """Say that the output is whole. ``tables`` are exported as JSON lines below it, by their names."""
        schemas = {name: table.schema.json() for name, table in tables.items()}
        self._write("complete", {"version": self.version, "schemas": schemas})

    def finished(self, splits: str = "splits") -> dict[str, DataFrame] | None:
        """All tables of a finished preparation, or None. No source is listed and nothing is computed."""
        known = self._read("complete")
        if known is None:
            return None
        self._check(known)
        found = {splits: self.spark.read.parquet(f"{self.output}/{splits}")}
        for name, schema in known["schemas"].items():
            kind = T.StructType.fromJson(json.loads(schema))
            found[name] = self.spark.read.schema(kind).json(f"{self.output}/{name}")
        return found
