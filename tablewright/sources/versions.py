"""Tables in versions: a version is written whole, then made the current one by one rename.

A table's folder holds ``v=1``, ``v=2``, ... and the file ``CURRENT`` with the number of the version that counts. A write
that fails leaves a folder nobody reads, and the version before stays the current one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.access import PERMISSIONS, audit_line
from tablewright.operators.fixes import apply_fixes
from tablewright.operators.quality import scorecard
from tablewright.sources.files import append_audit, export_masked

CURRENT = "CURRENT"


class Versions:
    """The versions of one table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the current version; 0 if there is none."""
        at = self._path(f"{self.folder}/{CURRENT}")
        if not self._files.exists(at):
            return 0
        return int(self.spark.read.text(at.toString()).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={version or self.current()}")

    def write(self, df: DataFrame) -> int:
        """Write ``df`` as the next version, which does not count before ``switch``; what a failed write left is replaced."""
        version = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        return version

    def switch(self, version: int) -> None:
        """Make a written version the current one."""
        draft, at = (self._path(f"{self.folder}/{name}") for name in (f"{CURRENT}.{version}", CURRENT))
        out = self._files.create(draft, True)
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        both = self.spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
        both[0] = context.Options.Rename.OVERWRITE
        context.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, both)


def publish(df: DataFrame, folder: str) -> Versions:
    """``df`` as the next version of the table in ``folder``."""
    table = Versions(df.sparkSession, folder)
    table.switch(table.write(df))
    return table


def apply(spark: SparkSession, folder: str, selected: Sequence[str], role: str, user: str, dataset: str, audit: str, export: str) -> DataFrame:
    """Fix the current version as a new one; (dataset, version, rows, before, after, gain), one row.

    The new version is written and scored, its masked copy is exported and the audit line appended; the switch comes last.
    A role without the permission changes nothing.
    """
    if "apply_safe_fixes" not in PERMISSIONS.get(role.strip().upper(), ()):
        raise PermissionError("Permission Denied: User role is restricted from applying fixes.")
    table = Versions(spark, folder)
    before = table.read()
    version = table.write(apply_fixes(before, selected))
    after = table.read(version)
    score = lambda df, name: scorecard(df, dataset).select("dataset", F.col("overall_quality").alias(name))
    scores, rows = score(before, "before").join(score(after, "after"), "dataset").first(), after.count()
    export_masked(after, role, export)
    told = f"Transformed dataset {dataset} with modifications: {json.dumps(list(selected))}."
    line = audit_line(F.lit(user), F.lit("Apply Safe Fixes"), F.lit("SUCCESS"), F.lit(told))
    append_audit(spark.range(1).select(line.alias("line")), audit)
    table.switch(version)
    row = (dataset, version, rows, scores["before"], scores["after"], scores["after"] - scores["before"])
    return spark.createDataFrame([row], "dataset string, version int, rows long, before int, after int, gain int")
