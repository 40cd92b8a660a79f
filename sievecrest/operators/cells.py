"""A versioned store of score cells that new runs merge into.

A cell is one (group, score) with its rows, positives and negatives. Cells add up, so the rows of a run
are read once, when it arrives, and every threshold, percentile and summary afterwards reads cells:
at most one a distinct score of a group, however many rows there are.

The store is a folder. ``parts/<batch>`` holds the cells of one batch as Parquet; ``log`` holds one
small JSON file a version, created only if it does not exist yet, so two writers never take the same
version and the later one tries the next. A batch that is in the log is not added again, which makes
a repeated call or a replayed stream batch harmless; a part whose writer died before its log entry is
overwritten by the next try and read by nobody. A part mostly holds one run, so a filter on the run
skips the others by their column statistics.

Rows without a score are kept as one cell a group with a NULL score: they count in ``unscored`` and in the
number of rows of ``distribution``, and nowhere else. Rows without a label count as neither class. NULL
groups are groups. ``retract`` takes back rows that were added: their cells are subtracted, and a cell that
falls below zero is an error. Repeated rows count as often as they are added.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecrest.operators import metrics as M
from sievecrest.session import cut_lineage

COUNTS = ("n", "pos", "neg")
_LOG = "version long, part string, kind string"
_NAME = re.compile(r"[A-Za-z0-9][\w.-]*")


class CellStore:
    """Score cells grouped by ``by`` below the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, by: Sequence[str] = ()):
        self.spark, self.root, self.by = spark, root.rstrip("/"), list(by)

    # ---- log

    def log(self) -> list:
        """Entries (version, part, kind) in order; one a batch, never more than that."""
        folder = self._path("log")
        if not self._files(folder).exists(folder):
            return []
        return self.spark.read.schema(_LOG).json(f"{self.root}/log").orderBy("version").collect()

    def version(self) -> int:
        """Newest version; 0 before anything was added."""
        return max((r["version"] for r in self.log()), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """Names of the parts whose cells make up a version."""
        names: list[str] = []
        for entry in self.log():
            if version is None or entry["version"] <= version:
                names = [entry["part"]] if entry["kind"] == "compact" else [*names, entry["part"]]
        return names

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _commit(self, version: int, part: str, kind: str) -> bool:
        """Take a version; False if another writer has it."""
        path = self._path(f"log/{version:012d}.json")
        files = self._files(path)
        if files.exists(path):
            return False
        try:
            out = files.create(path, False)
        except Exception:
            if files.exists(path):
                return False
            raise
        out.write(bytearray(json.dumps({"version": version, "part": part, "kind": kind}) + "\n", "utf-8"))
        out.close()
        return True

    # ---- writing

    def add(self, rows: DataFrame, score: str, label: str, batch: str) -> int:
        """Merge the rows of one batch in, reading nothing else; returns the version that holds them."""
        return self._merge(rows, score, label, batch, 1)

    def retract(self, rows: DataFrame, score: str, label: str, batch: str) -> int:
        """Take rows back that were added before, such as those of a run that was scored wrongly."""
        return self._merge(rows, score, label, batch, -1)

    def _merge(self, rows: DataFrame, score: str, label: str, batch: str, sign: int) -> int:
        if not _NAME.fullmatch(batch) or batch.startswith("compact-"):
            raise ValueError(f"no batch name: {batch!r}")
        kind = "add" if sign > 0 else "retract"
        known = self._known(batch, kind)
        if known:
            return known
        cells = rows.groupBy(*self.by, F.col(score).cast("double").alias("score")).agg(
            (F.count(F.lit(1)) * sign).alias("n"),
            (F.count_if(F.col(label) == 1) * sign).alias("pos"),
            (F.count_if(F.col(label) == 0) * sign).alias("neg"),
        )
        cells.write.mode("overwrite").parquet(f"{self.root}/parts/{batch}")
        version = self.version() + 1
        while not self._commit(version, batch, kind):
            known = self._known(batch, kind)
            if known:
                return known
            version += 1
        return version

    def _known(self, batch: str, kind: str) -> int:
        for entry in self.log():
            if entry["part"] == batch:
                if entry["kind"] != kind:
                    raise ValueError(f"batch {batch!r} was merged as {entry['kind']!r}")
                return entry["version"]
        return 0

    def compact(self) -> int:
        """Write the merged cells as one part; the version before stays readable from the parts it had."""
        version = self.version()
        part = f"compact-{version + 1}"
        self._merged(version).write.mode("overwrite").parquet(f"{self.root}/parts/{part}")
        if not self._commit(version + 1, part, "compact"):
            raise RuntimeError("rows were added while the store was compacted; compact again")
        return version + 1

    def follow(self, stream: DataFrame, score: str, label: str, checkpoint: str, name: str = "stream") -> int:
        """Merge what a stream has to offer; a batch that runs again after a failure is merged once."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.add(batch, score, label, f"{name}-{batch_id}")

        run = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        return self.version()

    # ---- reading

    def _merged(self, version: int | None) -> DataFrame:
        parts = self.parts(version)
        if not parts:
            raise ValueError("nothing was added to the store yet")
        cells = self.spark.read.parquet(*[f"{self.root}/parts/{p}" for p in parts])
        cells = cells.groupBy(*self.by, "score").agg(*[F.sum(c).alias(c) for c in COUNTS])
        below = F.least(*COUNTS) < 0
        error = F.raise_error(F.lit("rows were retracted that had not been added"))
        checked = F.when(below, error.cast("long")).otherwise(F.col("n"))
        return cells.withColumn("n", checked).where(F.col("n") != 0)

    def cells(self, version: int | None = None) -> DataFrame:
        """(by, score, n, pos, neg) of all scored rows up to a version, the newest by default."""
        return self._merged(version).where(F.col("score").isNotNull())

    def unscored(self, version: int | None = None) -> DataFrame:
        """(by, unscored): rows without a score, of every group."""
        missing = F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0))
        return self._merged(version).groupBy(*self.by).agg(missing.alias("unscored"))

    def summary(self, version: int | None = None) -> DataFrame:
        """``metrics.eval_summary`` of the rows of a version."""
        return M.summary_from_cells(cut_lineage(self.cells(version)), self.by)

    def best_threshold(self, version: int | None = None, start: float = float("-inf")) -> DataFrame:
        """``metrics.best_threshold`` of the rows of a version."""
        return M.best_from_cells(cut_lineage(self.cells(version)), self.by, start)

    def percentiles(self, points: Sequence[float], version: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
        """``metrics.exact_percentiles`` of the scores of a version."""
        return M.percentiles_from_cells(cut_lineage(self.cells(version)), "score", points, self.by, names)

    def distribution(self, version: int | None = None) -> DataFrame:
        """``metrics.distribution_report`` of the rows of a version."""
        return M.distribution_from_cells(cut_lineage(self._merged(version)), self.by)
