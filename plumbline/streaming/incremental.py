"""Taking in new source files one micro-batch at a time.

Every batch writes its own folder, named by the batch id, in overwrite mode: a batch that is
run again after a failure replaces its own output, so results are exactly-once. The file
source's checkpoint remembers which files are done. The label dictionary grows by such folders too: a
batch adds codes for the labels that no batch before it had, after the last code, so a code never changes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.checks import guard
from plumbline.functions.hashing import divisible, seeded_hash
from plumbline.functions.lookup import bounded_lookup
from plumbline.functions.numeric import clean_float
from plumbline.operators import accounting, audit, labels, sampling
from plumbline.operators.splits import drop_unassigned, row_identity
from plumbline.plans.prepare import Preparation
from plumbline.session import written
from plumbline.sources.integrity import fingerprint_mismatch
from plumbline.sources.scan import FILE_ID, RELATIVE_PATH, ROW_ID, open_files, with_row_identity
from plumbline.sources.sink import ROWS_PER_PART, check_counts, export_table, read_split


class IncrementalPreparation:
    """Streaming preparation of a growing directory into ``<output>``.

    ``assign`` maps a table with row identity to one with label, keep, open_set, split and
    ``_identity`` columns (see ``accounting.classify_and_split``). ``features`` are written as clean
    float32. ``settings`` is any text that stands for how rows are labelled and split: an output made
    with other settings, columns or schema is refused. One identity in ``identity_divisor`` is kept for
    the audit, as in ``audit.leakage_sampled``; 1 keeps all.
    """

    def __init__(
        self,
        spark: SparkSession,
        directory: str,
        schema: T.StructType,
        assign: Callable[[DataFrame], DataFrame],
        output: str,
        columns: Sequence[str],
        pattern: str = "*.parquet",
        files_per_batch: int = 1,
        group_aware: bool = True,
        strategy: str = "auto_group_aware",
        rows_per_part: int = ROWS_PER_PART,
        features: Sequence[str] = (),
        settings: str = "",
        identity_divisor: int = 1,
        plan: DataFrame | None = None,
        sampling_seed: int = 0,
        encode: bool = False,
        require_all_classes: bool = True,
        audit_switches: Mapping | None = None,
    ) -> None:
        if identity_divisor <= 0:
            raise ValueError("The identity sample divisor must be positive")
        self.features, self.settings, self.identity_divisor = list(features), settings, identity_divisor
        self.spark, self.directory, self.schema = spark, directory, schema
        self.assign, self.columns, self.pattern = assign, list(columns), pattern
        self.files_per_batch, self.group_aware = files_per_batch, group_aware
        self.strategy, self.rows_per_part = strategy, rows_per_part
        self.output = output.rstrip("/")
        self.plan, self.sampling_seed, self.encode = plan, sampling_seed, encode
        self.require_all_classes, self.audit_switches = require_all_classes, audit_switches

    @classmethod
    def of(cls, preparation: Preparation, output: str, files_per_batch: int = 1) -> IncrementalPreparation:
        """The same rows, features, codes and gates as ``preparation.write``, a batch of files at a time.

        For files of one layout. Codes are those of the whole preparation where the first batch holds all labels.
        """
        settings = preparation.settings
        columns = [*preparation.features, FILE_ID, ROW_ID]
        return cls(
            preparation.spark,
            preparation.directory,
            open_files(preparation.spark, preparation.directory, preparation.source.pattern).schema,
            preparation.from_files,
            output,
            columns,
            pattern=preparation.source.pattern.removeprefix("**/"),
            files_per_batch=files_per_batch,
            group_aware=preparation.group_aware,
            strategy=settings.strategy,
            rows_per_part=int(settings.output.get("rows_per_part", ROWS_PER_PART)),
            features=preparation.features,
            settings=settings.as_text(),
            identity_divisor=int(settings.audit.get("identity_sample_divisor", 64))
            if settings.audit.get("backend", "exact") == "sampled_exact"
            else 1,
            plan=preparation.plan,
            sampling_seed=settings.sampling_seed,
            encode=True,
            require_all_classes=bool(settings.split.get("require_all_classes_each_split", True)),
            audit_switches=settings.audit,
        )

    # ---- running ---------------------------------------------------------------------------

    def _sampled(self, batch: DataFrame) -> DataFrame:
        """The planned rows of the batch's files, those with the smallest seeded hash of each."""
        if self.plan is None:
            return batch
        files = batch.select(F.col(RELATIVE_PATH).alias("relative_path")).distinct()
        guard(files.join(self.plan, "relative_path", "left_anti"), True, "Files that the sampling plan does not know")
        wanted = self.plan.join(files, "relative_path", "left_semi")
        if wanted.where("planned_rows < physical_rows").isEmpty():
            return batch
        quotas = wanted.select(
            F.col("relative_path").alias(RELATIVE_PATH),
            F.col("physical_rows").alias("rows"),
            F.col("planned_rows").alias("quota"),
        )
        return sampling.draw(batch, [RELATIVE_PATH], quotas, row_identity(), self.sampling_seed)

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        needed = [
            *self.columns, RELATIVE_PATH, FILE_ID, ROW_ID,
            "label", "keep", "open_set", "split", "in_scope", "_identity",
        ]
        # A written table and not a cache: memory stays flat however large a file is, and each output reads its own columns.
        assigned = written(self.assign(self._sampled(batch)).select(*dict.fromkeys(needed)), "assigned")
        if self.encode:
            self._grow(assigned, batch_id)
        self._write(assigned, f"batch={batch_id}", batch_id)

    def dictionary(self, before: int | None = None) -> DataFrame:
        """(label, code) of all batches, or of those before one."""
        try:
            known = self._read("labels")
        except AnalysisException:
            return self.spark.createDataFrame([], "label string, code int")
        return (known if before is None else known.where(F.col("batch") < before)).select("label", "code")

    def _grow(self, assigned: DataFrame, batch_id: int) -> None:
        """Codes for the labels of this batch that no batch before had, in name order after the last code."""
        known = self.dictionary(batch_id)
        after = known.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("after")).first()["after"]
        trained = drop_unassigned(assigned).where(~F.col("open_set")).select("label")
        new = labels.label_mapping(trained.join(F.broadcast(known), "label", "left_anti"))
        found = new.select("label", (F.col("code") + after).cast("int").alias("code"))
        found.write.mode("overwrite").parquet(f"{self.output}/labels/batch={batch_id}")

    def _write(self, assigned: DataFrame, folder: str, batch_id: int) -> None:
        placed = drop_unassigned(assigned)
        rows = placed.withColumns({f: clean_float(F.col(f)) for f in self.features})
        kept = [*self.columns, "label", "open_set", "split", RELATIVE_PATH]
        if self.encode:
            rows = labels.encode_labels(rows, self.dictionary(batch_id + 1))
            # An open-set label is no class, also where another run had trained on it.
            code = F.when(F.col("open_set"), F.lit(labels.OPEN_SET_CODE)).otherwise(F.col("_label"))
            rows, kept = rows.withColumn("_label", code), [*kept, "_label"]
        (
            rows.select(*kept)
            .write.mode("overwrite")
            .partitionBy("split")
            .option("maxRecordsPerFile", self.rows_per_part)
            .parquet(f"{self.output}/splits/{folder}")
        )
        counted = accounting.counted(assigned)
        counted.write.mode("overwrite").parquet(f"{self.output}/counts/{folder}")
        group = "_identity" if self.group_aware else None
        ids = audit.identities(placed.withColumn("_row", row_identity()), "_row", group)
        ids = audit.audit_scope(ids, self.strategy)
        if self.identity_divisor > 1:
            ids = ids.where(divisible(seeded_hash(audit.AUDIT_SALT, F.col("id")), self.identity_divisor))
        # One row per identity and split of a batch is all a later audit needs. Row identities hardly ever repeat, so they
        # are written as they come and meet only in the audit; groups fold.
        is_row = F.col("kind") == "sample"
        folded = ids.where(~is_row).groupBy("kind", "id", "split").agg(F.count("*").alias("rows"))
        singles = ids.where(is_row).withColumn("rows", F.lit(1).cast("long"))
        singles.unionByName(folded).write.mode("overwrite").parquet(f"{self.output}/identities/{folder}")
        # The counts of this batch hold every row, so the files' figures are sums of them.
        counts = self.spark.read.schema(counted.schema).parquet(f"{self.output}/counts/{folder}")
        rows_of = lambda which: F.coalesce(F.sum(F.when(which, F.col("rows"))), F.lit(0)).cast("long")
        (
            counts.groupBy(RELATIVE_PATH)
            .agg(
                rows_of(F.lit(True)).alias("rows_read"),
                rows_of(~F.col("keep")).alias("excluded_by_label"),
                rows_of(F.col("keep") & F.col("split").isNull()).alias("excluded_by_split"),
                rows_of(F.col("split").isNotNull()).alias("rows_written"),
            )
            .withColumn("finished_at", F.current_timestamp())
            .write.mode("overwrite")
            .parquet(f"{self.output}/progress/{folder}")
        )

    def run(self) -> IncrementalPreparation:
        """Take in every file that is not done yet, then stop. A restart continues."""
        made_with = [self.settings, self.strategy, str(self.group_aware), str(self.identity_divisor)]
        made_with += [",".join(self.columns), ",".join(self.features), self.schema.json()]
        made_with += [str(self.encode), str(self.sampling_seed if self.plan is not None else "")]
        fingerprint = F.sha2(F.concat_ws("\x1f", *[F.lit(x) for x in made_with]), 256)
        check_resume(self.spark, self.spark.range(1).select(fingerprint.alias("fingerprint")), f"{self.output}/settings")
        reader = (
            self.spark.readStream.schema(self.schema)
            .option("maxFilesPerTrigger", self.files_per_batch)
            .option("pathGlobFilter", self.pattern)
            .option("recursiveFileLookup", "true")
        )
        stream = with_row_identity(reader.parquet(self.directory), self.directory)
        query = (
            stream.writeStream.foreachBatch(self._batch)
            .option("checkpointLocation", f"{self.output}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self

    # ---- results ---------------------------------------------------------------------------

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.output}/{name}")

    def splits(self) -> DataFrame:
        return self._read("splits").drop("batch")

    def split(self, name: str, columns: Sequence[str]) -> DataFrame:
        return read_split(self.spark, f"{self.output}/splits", name, columns)

    def progress(self) -> DataFrame:
        """One row per finished source file."""
        return self._read("progress")

    def audit(self) -> DataFrame:
        """Exact verdict over the identities of all batches so far, restarts included."""
        return incremental_audit(self._read("identities"), self.group_aware)

    def counts(self) -> DataFrame:
        """Rows per file, label, policy and split of all batches, counted while they were taken in."""
        columns = [RELATIVE_PATH, "label", "keep", "open_set", "split"]
        return self._read("counts").groupBy(*columns).agg(F.sum("rows").alias("rows"))

    def close(self, fail: bool = True) -> dict[str, DataFrame]:
        """The result tables of a whole preparation over all batches, behind its gates; exported next to the splits.

        No empty split, every trained class in every split, a label trained or open but not both, rows read as planned,
        an account that balances, as many rows on disk as counted, and the leakage audit. More files may
        be taken in afterwards; closing again covers them.
        """
        counts = written(self.counts(), "incremental-counts")
        classes = bounded_lookup(accounting.split_class_rows(counts, rows="rows"))
        by_split = lambda t: t.groupBy("split").agg(F.sum("rows").alias("rows"))
        sizes = {r["split"]: r["rows"] for r in by_split(classes).collect()}
        empty = [s for s in audit.SPLITS if not sizes.get(s)]
        if fail and empty:
            raise ValueError(f"Empty split: {empty}")
        accounting.missing_classes(classes, fail=fail and self.require_all_classes)
        labels.trainable_open_overlap(classes.where(~F.col("open_set")), classes.where(F.col("open_set")), fail=fail)
        tables = {
            "class_counts": classes,
            "open_set_labels": labels.open_set_labels(classes),
            "row_account": bounded_lookup(accounting.row_accounting(counts, fail, rows="rows")),
            "leakage_audit": bounded_lookup(self.audit()),
        }
        if self.plan is not None:
            tables["source_inventory"] = accounting.source_inventory(counts, self.plan, rows="rows")
            accounting.sampling_count_check(tables["source_inventory"], fail)
        on_disk = self._read("splits").groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("rows"))
        check_counts(on_disk, by_split(classes), fail)
        audit.enforce_audit(tables["leakage_audit"], self.group_aware, self.audit_switches, fail)
        if self.encode:
            tables["label_mapping"] = self.dictionary()
        for name, table in tables.items():
            export_table(table, f"{self.output}/{name}", "json")
        return tables

    def status(self, source_files: int) -> DataFrame:
        return prepare_status(self.progress(), self._read("splits"), source_files)


def incremental_audit(stored: DataFrame, group_aware: bool = True) -> DataFrame:
    """Per kind: identities, overlap of each split pair, repeats inside a split, verdict."""
    rows_in = {s: F.sum(F.when(F.col("split") == s, F.col("rows")).otherwise(0)) for s in audit.SPLITS}
    per_id = stored.groupBy("kind", "id").agg(*[c.alias(s) for s, c in rows_in.items()])
    in_splits = sum((F.col(s) > 0).cast("int") for s in audit.SPLITS)
    repeats = sum(F.greatest(F.col(s) - 1, F.lit(0)) for s in audit.SPLITS)
    ignored = F.lit(not group_aware) & (F.col("kind") == "group")
    return (
        per_id.groupBy("kind")
        .agg(
            F.count("*").alias("identities"),
            F.count_if(in_splits > 1).alias("cross_split"),
            F.sum(F.when(F.col("kind") == "sample", repeats).otherwise(F.lit(0))).alias(
                "duplicates_within_split"
            ),
            *[
                F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}")
                for a, b in audit.PAIRS
            ],
        )
        .withColumn("passed", (F.col("cross_split") == 0) | ignored)
    )


def prepare_status(progress: DataFrame, splits: DataFrame, source_files: int) -> DataFrame:
    """One row: finished files, rows, parts per split, and whether everything is done."""
    parts = splits.select("split", F.col("_metadata.file_path").alias("_path")).distinct()
    counted = parts.agg(
        *[F.count_if(F.col("split") == s).alias(f"parts_{s}") for s in audit.SPLITS]
    )
    done = progress.agg(
        F.count("*").alias("completed_files"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
        F.max("finished_at").alias("updated_at"),
    )
    status = F.when(F.col("completed_files") >= source_files, "complete").otherwise("preparing")
    both = done.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("status", status)


def check_resume(spark: SparkSession, current: DataFrame, path: str) -> bool:
    """Record the fingerprint of a run, or refuse to resume one made from other inputs.

    True when there was a record and it matches.
    """
    try:
        recorded = spark.read.json(path)
    except AnalysisException:
        current.write.mode("error").json(path)
        return False
    fingerprint_mismatch(current, recorded, fail=True)
    return True
