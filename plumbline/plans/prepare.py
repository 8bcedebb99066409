"""From a directory of Parquet files to audited train / validation / test splits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.lookup import bounded_lookup, bounded_rows
from plumbline.functions.numeric import clean_float
from plumbline.functions.text import key_text
from plumbline.operators import accounting, audit, labels, sampling
from plumbline.operators.splits import (
    CaptureDays,
    check_ratios,
    check_strategy,
    drop_unassigned,
    row_identity,
)
from plumbline.plans.ledger import StageLedger
from plumbline.session import fresh_path
from plumbline.sources import integrity, scan, sink

REQUIRED = ("dataset", "split", "preprocessing", "output", "audit")
DAY_COLUMN = "__capture_day"  # fixed value: the default day column


@dataclass
class PrepareSettings:
    """The sections of a preparation config: dataset, split, labels, preprocessing, output, audit."""

    dataset: Mapping
    split: Mapping
    labels: Mapping = field(default_factory=dict)
    preprocessing: Mapping = field(default_factory=dict)
    output: Mapping = field(default_factory=dict)
    audit: Mapping = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping) -> PrepareSettings:
        absent = [name for name in REQUIRED if name not in config]
        if absent:
            raise ValueError(f"Missing configuration sections: {absent}")
        if config["preprocessing"].get("scaling", "none") != "none":
            raise ValueError("Numeric features must not be scaled")
        return cls(**{name: config.get(name) or {} for name in (*REQUIRED, "labels")})

    def __post_init__(self) -> None:
        self.ratios = check_ratios([self.split.get(n, 0) for n in ("train", "validation", "test")])
        self.strategy = check_strategy(str(self.split.get("strategy", "auto_group_aware")))
        self.policy = labels.LabelPolicy.from_config(self.labels)
        self.seed = int(self.split["seed"])
        self.sampling_seed = int(self.dataset.get("sampling_seed") or self.seed)
        self.roles = (
            CaptureDays.of(self.split.get("capture_day_assignment"))
            if self.strategy == "by_capture_day"
            else None
        )


    def as_text(self) -> str:
        """All sections, in an order of their own: equal settings give equal text."""
        return json.dumps({name: getattr(self, name) for name in (*REQUIRED, "labels")}, sort_keys=True)

    def version(self) -> str:
        """Names a prepared dataset by its settings alone."""
        return hashlib.sha256(self.as_text().encode()).hexdigest()


class Preparation:
    """Lazy tables of one preparation run; :meth:`write` is the only step that writes."""

    def __init__(self, spark: SparkSession, settings: PrepareSettings | Mapping) -> None:
        if not isinstance(settings, PrepareSettings):
            settings = PrepareSettings.from_config(settings)
        self.spark, self.settings = spark, settings
        self.ledger: StageLedger | None = None
        dataset = settings.dataset
        self.directory = str(dataset["data_dir"])
        self.source = scan.UnifiedSource(
            spark, self.directory, dataset.get("file_pattern", "**/*.parquet")
        )
        columns = self.source.columns
        self.target = scan.find_column(
            columns, dataset.get("target_column"), dataset.get("target_column_candidates", [])
        )
        if self.target is None and not dataset.get("label_from_filename_if_missing", False):
            raise ValueError("No target column found and file-name labels are disabled")
        self.group_columns = scan.find_group_columns(
            columns, dataset.get("group_column_candidates", [])
        )
        if settings.strategy == "group_aware" and not self.group_columns:
            raise ValueError("group_aware needs group columns and none were found")
        self.group_aware = bool(self.group_columns) and settings.strategy != "row_hash"
        self.day_column = None
        if settings.strategy == "by_capture_day":
            configured = str(settings.split.get("capture_day_column", DAY_COLUMN))
            self.day_column = scan.find_column(columns, configured, [])

    # ---- plan -----------------------------------------------------------------------------

    @cached_property
    def plan(self) -> DataFrame:
        """(relative_path, physical_rows, planned_rows), from footers only."""
        sizes = self.source.files.join(self.source.footers, "path").select(
            "relative_path", F.col("file_rows").alias("rows")
        )
        return bounded_lookup(
            sampling.sampling_plan(
                bounded_lookup(sizes),
                "relative_path",
                self.settings.dataset.get("samples_per_file"),
                self.settings.dataset.get("target_total_rows"),
            )
        )

    def _sampled(self, table: DataFrame) -> DataFrame:
        dataset = self.settings.dataset
        if dataset.get("target_total_rows") is None:
            return table
        quotas = self.plan.select(
            F.col("relative_path").alias(scan.RELATIVE_PATH),
            F.col("physical_rows").alias("rows"),
            F.col("planned_rows").alias("quota"),
        )
        return sampling.draw(
            table, [scan.RELATIVE_PATH], quotas, row_identity(), self.settings.sampling_seed
        )

    def _rows(self, columns: list[str]) -> DataFrame:
        return self.source.table(
            columns,
            text_columns=self.group_columns,
            rows_per_file=self.settings.dataset.get("samples_per_file"),
        )

    def _wanted(self, columns: list[str]) -> list[str]:
        keys = [c for c in (self.target, *self.group_columns, self.day_column) if c]
        return list(dict.fromkeys([*keys, *columns]))

    def _assigned(self, columns: list[str]) -> DataFrame:
        return self.classified(self._sampled(self._rows(self._wanted(columns))))

    def classified(self, table: DataFrame) -> DataFrame:
        """Label, policy and split of rows of the source, whichever way they were read."""
        raw = (
            labels.canonical_label(F.col(f"`{self.target}`"))
            if self.target
            else labels.canonical_label(labels.label_from_file_name(F.col(scan.RELATIVE_PATH)))
        )
        split = self.settings.split
        return accounting.classify_and_split(
            table.withColumn("label", raw),
            self.settings.policy,
            strategy=self.settings.strategy,
            seed=self.settings.seed,
            ratios=self.settings.ratios,
            group_columns=self.group_columns if self.group_aware else (),
            # The source renders key columns as text, layout by layout.
            group=key_text(*[f"`{c}`" for c in self.group_columns]) if self.group_aware else None,
            day_column=self.day_column,
            day_roles=self.settings.roles,
            validation_fraction=float(split.get("validation_fraction_of_train_day", 0.15)),
        )

    def from_files(self, files: DataFrame) -> DataFrame:
        """:meth:`classified` over a frame with the files' own columns, as a stream delivers them.

        Files of one layout only: a stream has one schema.
        """
        table = self.source.renamed(files, self._wanted(self.features), self.group_columns)
        limit = self.settings.dataset.get("samples_per_file")
        return self.classified(table if limit is None else table.where(F.col(scan.ROW_ID) < int(limit)))

    @cached_property
    def narrow(self) -> DataFrame:
        """Label, split and identity of every row; only key columns are read."""
        return self._assigned([]).select(
            "label", "keep", "open_set", "split", "in_scope", "_identity",
            scan.RELATIVE_PATH, scan.FILE_ID, scan.ROW_ID,
        )

    # ---- columns ----------------------------------------------------------------------------

    @cached_property
    def roles(self) -> list[tuple[str, str, str | None]]:
        rules = self.settings.preprocessing
        schema = self.source.table().select(*[f"`{c}`" for c in self.source.columns]).schema
        return scan.column_roles(
            schema,
            self.target,
            self.group_columns,
            rules.get("explicit_drop_columns", []),
            rules.get("drop_name_patterns", []),
        )

    @cached_property
    def features(self) -> list[str]:
        return scan.feature_names(self.roles)

    def dropped_columns(self) -> DataFrame:
        """(column, reason) of every column that is not a feature."""
        known = [(name, reason) for name, _, reason in self.roles if reason is not None]
        table = self.spark.createDataFrame(known, "column string, reason string")
        return table.unionByName(self.source.dropped())

    # ---- checks -----------------------------------------------------------------------------

    @cached_property
    def counts(self) -> DataFrame:
        """Rows per file, label, policy and split: one narrow scan, kept as a written table.

        With a ledger, the table of a run before is read where there is one.
        """
        if self.ledger is not None:
            return self.ledger.stage("counts", lambda: accounting.counted(self.narrow))
        path = fresh_path(self.spark, "class-counts")
        accounting.counted(self.narrow).write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def class_rows(self) -> DataFrame:
        """(label, open_set, split, rows), one row per class and split."""
        return bounded_lookup(accounting.split_class_rows(self.counts, rows="rows"))

    def preflight(self, fail: bool = True) -> DataFrame:
        """Coverage before any feature is read; raises on an empty split or a missing class."""
        sizes = self.class_rows.groupBy("split").agg(F.sum("rows").alias("rows"))
        found = {r["split"]: r["rows"] for r in bounded_rows(sizes)}
        if fail:
            empty = [s for s in ("train", "validation", "test") if not found.get(s)]
            if empty:
                raise ValueError(f"Empty split before any preprocessing: {empty}")
        required = bool(self.settings.split.get("require_all_classes_each_split", True))
        accounting.missing_classes(self.class_rows, fail=fail and required)
        return self.class_rows

    @cached_property
    def mapping(self) -> DataFrame:
        trainable = self.class_rows.where(~F.col("open_set"))
        opened = self.class_rows.where(F.col("open_set"))
        labels.trainable_open_overlap(trainable, opened, fail=True)
        return bounded_lookup(labels.label_mapping(trainable))

    def prepared(self) -> DataFrame:
        """Clean float features, row identity and label code of every row that has a split."""
        rows = drop_unassigned(self._assigned(self.features))
        encoded = labels.encode_labels(rows, self.mapping)
        return encoded.select(
            *[clean_float(F.col(f"`{c}`")).alias(c) for c in self.features],
            scan.FILE_ID,
            scan.ROW_ID,
            "_label",
            "split",
            "in_scope",
        )

    def leakage(self) -> DataFrame:
        """The configured audit over sample and group identities."""
        rows = self.narrow.withColumn("_row", row_identity())
        group = "_identity" if self.group_aware else None
        ids = audit.audit_scope(audit.identities(rows, "_row", group), self.settings.strategy)
        if self.settings.audit.get("backend", "exact") == "sampled_exact":
            result = audit.leakage_sampled(
                ids, int(self.settings.audit.get("identity_sample_divisor", 64))
            )
            limit = self.settings.audit.get("maximum_tracked_identities")
            if limit:
                result = bounded_lookup(result)
                audit.tracked_limit(result, int(limit))
            return result
        return audit.leakage_exact(ids, self.group_aware)

    def inventory(self) -> DataFrame:
        return accounting.source_inventory(self.counts, self.plan, rows="rows")

    def account(self, fail: bool = True) -> DataFrame:
        return accounting.row_accounting(self.counts, fail, rows="rows")

    def fingerprint(self) -> DataFrame:
        files = self.source.files.join(self.source.footers, "path").select(
            "relative_path", F.col("file_rows").alias("rows"), "bytes"
        )
        return integrity.input_fingerprint(files, self.settings.as_text(), self.features, self.target)

    # ---- writing ------------------------------------------------------------------------------

    def write(self, path: str) -> dict[str, DataFrame]:
        """Check, write ``<path>/splits`` and the result tables next to it.

        What a run before finished below ``path`` is not done again: a whole preparation is read back, a
        broken one goes on after its last finished stage. A path that holds other settings or inputs is refused.
        """
        path = path.rstrip("/")
        self.ledger = ledger = StageLedger(self.spark, path, self.settings.version())
        finished = ledger.finished()
        if finished is not None:
            return finished
        fingerprint = bounded_lookup(self.fingerprint())
        ledger.begin(fingerprint.first()["fingerprint"])
        counts = self.preflight()
        inventory = bounded_lookup(self.inventory())
        accounting.sampling_count_check(inventory, fail=True)
        account = bounded_lookup(self.account())
        leakage = bounded_lookup(ledger.stage("leakage", self.leakage))
        audit.enforce_audit(leakage, self.group_aware, self.settings.audit)
        if ledger.whole("splits"):
            written = self.spark.read.parquet(f"{path}/splits")
        else:
            written = sink.write_splits(
                self.prepared(),
                f"{path}/splits",
                int(self.settings.output.get("rows_per_part", sink.ROWS_PER_PART)),
                str(self.settings.output.get("compression", "zstd")),
                mode="overwrite",
            )
        found = bounded_lookup(
            written.groupBy("_label", F.col("split").cast("string").alias("split")).agg(
                F.count("*").alias("rows")
            )
        )
        by_split = lambda t: t.groupBy("split").agg(F.sum("rows").alias("rows"))
        sink.check_counts(by_split(found), by_split(counts))
        accounting.label_integrity(found, fail=True, rows="rows")
        realised = labels_of(found, self.mapping)
        accounting.preflight_agrees(
            accounting.missing_classes(counts), accounting.missing_classes(realised), fail=True
        )
        tables = {
            "label_mapping": self.mapping,
            "open_set_labels": labels.open_set_labels(counts),
            "class_counts": counts,
            "row_account": account,
            "source_inventory": inventory,
            "leakage_audit": leakage,
            "dropped_columns": self.dropped_columns(),
            "features": scan.feature_table(self.spark, self.roles),
            "parts": sink.part_inventory(written, f"{path}/splits"),
            "fingerprint": fingerprint,
        }
        for name, table in tables.items():
            sink.export_table(table, f"{path}/{name}", "json")
        ledger.finish(tables)
        return {"splits": written, **tables}


def labels_of(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Written (_label, split, rows) as (label, open_set, split, rows)."""
    named = mapping.withColumnRenamed("code", "_label")
    return found.join(named, "_label", "left").select(
        F.coalesce("label", F.lit("")).alias("label"),
        F.col("label").isNull().alias("open_set"),
        "split",
        "rows",
    )


def prepare_dataset(spark: SparkSession, config: Mapping, output: str) -> dict[str, DataFrame]:
    """Prepare, audit and write a dataset described by a config mapping.

    An output that these settings finished before is read back; its sources need not be there any more.
    """
    settings = PrepareSettings.from_config(config)
    finished = StageLedger(spark, output, settings.version()).finished()
    return finished if finished is not None else Preparation(spark, settings).write(output)
