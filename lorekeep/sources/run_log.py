"""What runs were opened and published, as small entries that are folded from time to time.

An entry is a directory of one file: the opening of a run, or its publication with a row per table. Entries lie in epochs::

    log/epoch=000002/before/             everything up to this epoch, folded
    log/epoch=000002/ready/              written when ``before`` is whole
    log/epoch=000002/opened-…/           entries since
    log/epoch=000002/published-…/

After FOLD publications the next epoch begins, so a reader lists and reads one epoch: a bounded number of directories,
however many runs there were. Epochs follow each other without gaps; the last one is found by looking for ``ready`` in
doubling steps, from the epoch known before. A fold that failed half-way is not ready and is written again by the next
publication. Runs follow one another, so there is one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

FOLD = 10
#: One row of an opened run has no table_name. ``buckets`` are those of the table that the run wrote, null for all.
ENTRY = T.StructType(
    [*schemas.RUNS.fields, T.StructField("table_name", T.StringType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
)


class RunLog:
    def __init__(self, spark: SparkSession, root: str, fold: int = FOLD):
        self.spark, self.root, self.every = spark, f"{root}/log", fold
        self._known = 0

    def folder(self, epoch: int) -> str:
        return f"{self.root}/epoch={epoch:06d}"

    def _is_ready(self, epoch: int) -> bool:
        try:
            self.spark.read.schema(ENTRY).parquet(f"{self.folder(epoch)}/ready")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def epoch(self) -> int:
        """The last epoch that is ready; 0 needs no fold before it."""
        step = 1
        while self._is_ready(self._known + step):
            self._known += step
            step *= 2
        while step > 1:
            step //= 2
            if self._is_ready(self._known + step):
                self._known += step
        return self._known

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(self.folder(self.epoch()))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRY)

    def add(self, name: str, rows: DataFrame) -> None:
        """One entry, visible at once; adding it again under the same name replaces it."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRY])
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder(self.epoch())}/{name}")

    def fold(self) -> None:
        """Begin the next epoch if this one holds enough publications."""
        epoch, rows = self.epoch(), self.entries()
        here = F.expr("count_if(table_name = 'runs' AND _metadata.file_path NOT LIKE '%/before/%')")
        if rows.agg(here.alias("n")).first()["n"] < self.every:
            return
        rows.distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.folder(epoch + 1)}/before")
        self.spark.createDataFrame([], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.folder(epoch + 1)}/ready")
