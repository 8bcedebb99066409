"""Are the files still the ones that were recorded?"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.checks import guard
from plumbline.sources.scan import list_files, open_location

CHUNK_BYTES = 1 << 20


def integrity_manifest(spark: SparkSession, directory: str, pattern: str = "**/*") -> DataFrame:
    """(relative_path, bytes, sha256) of every file.

    Files are spread over the tasks and read in chunks, so a file of any size needs the
    memory of one chunk.
    """

    def digests(batches: Iterator) -> Iterator:
        for batch in batches:
            found = []
            for path in batch["path"]:
                system, location = open_location(path)
                digest = hashlib.sha256()
                with system.open_input_stream(location) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield batch[["relative_path", "bytes"]].assign(sha256=found)

    files = list_files(spark, directory, pattern)
    return files.mapInPandas(digests, "relative_path string, bytes bigint, sha256 string")


def integrity_check(found: DataFrame, recorded: DataFrame, fail: bool = False) -> DataFrame:
    """Files that are missing, new, or different from the recorded manifest."""
    old = recorded.select(
        "relative_path", F.col("bytes").alias("bytes_recorded"), F.col("sha256").alias("sha256_recorded")
    )
    problem = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256_recorded").isNull(), "not recorded")
        .when(F.col("bytes") != F.col("bytes_recorded"), "size differs")
        .when(F.col("sha256") != F.col("sha256_recorded"), "content differs")
    )
    bad = (
        found.join(old, "relative_path", "full_outer")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select("relative_path", "problem")
    )
    return guard(bad, fail, "Files differ from the recorded manifest")


def input_fingerprint(
    files: DataFrame, settings: str = "", features: Sequence[str] = (), target: str | None = None
) -> DataFrame:
    """One row: SHA-256 over settings, columns and every (relative_path, rows, bytes).

    The per-file hashes are combined by sum and xor, which need no order, so the file list is
    never collected.
    """
    one = F.sha2(
        F.concat_ws("|", "relative_path", F.col("rows").cast("string"), F.col("bytes").cast("string")),
        256,
    )
    number = F.conv(F.substring(one, 1, 15), 16, 10).cast("bigint")
    other = F.conv(F.substring(one, 16, 15), 16, 10).cast("bigint")
    combined = files.agg(
        F.count("*").alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
        F.sum(number.cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor(other).alias("_xor"),
    )
    text = F.concat_ws(
        "|",
        F.lit(settings),
        F.lit(",".join(features)),
        F.lit(target or ""),
        *[F.col(c).cast("string") for c in ("files", "rows", "bytes", "_sum", "_xor")],
    )
    return combined.select("files", "rows", "bytes", F.sha2(text, 256).alias("fingerprint"))


def fingerprint_mismatch(current: DataFrame, recorded: DataFrame, fail: bool = False) -> DataFrame:
    """The recorded fingerprint when it is not the current one."""
    stale = recorded.select("fingerprint").join(
        current.select("fingerprint"), "fingerprint", "left_anti"
    )
    return guard(stale, fail, "The checkpoint was made from other inputs or settings")
