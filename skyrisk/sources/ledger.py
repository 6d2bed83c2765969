"""Appends that happen once and as a whole: a ledger of committed runs.

A run writes its rows for every table into folders of its own, ``<table>/run=<id>/attempt=<random>``, and then commits
with one small file, ``<ledger>/<id>.json``, that names those folders.  Readers go by the ledger only, so

* a run that fails between two tables shows in neither, and its next attempt is not disturbed by what is left;
* a second run of the same id changes nothing, or with ``replace=True`` takes the place of the first;
* tables of one run are always in step.

The commit file is written beside its place and renamed, which is atomic on the file systems Spark jobs share
(HDFS and local ones; on an object store the single put of a small object is).  A ledger has one file for each run;
``compact`` makes one run of many, so neither the ledger nor the number of folders grows without end.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyrisk.session import cut_lineage

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._ -]*")
RUN = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("table", T.StringType()), T.StructField("folder", T.StringType()),
                    T.StructField("n_rows", T.LongType()), T.StructField("replaces", T.ArrayType(T.StringType()))])


@dataclass
class Ledger:
    spark: SparkSession
    path: str

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, run_id: str) -> str:
        if not _NAME.fullmatch(run_id):
            raise ValueError(f"a run id is letters, digits, dots, dashes, blanks and underlines, not {run_id!r}")
        return f"{self.path.rstrip('/')}/{run_id}.json"

    # ------------------------------------------------------------ reading
    def runs(self) -> DataFrame:
        """A row for each committed run and table, without runs that a compacted one replaces."""
        rows = self._lines()
        old = rows.select(F.explode("replaces").alias("run_id")).distinct()
        return rows.join(old, "run_id", "left_anti").select(*RUN.names)

    def committed(self, run_id: str) -> bool:
        """Whether the run is there, by itself or in a compacted one."""
        file, fs = self._fs(self._file(run_id))
        return fs.exists(file) or not self._lines().where(F.array_contains("replaces", run_id)).isEmpty()

    def _lines(self) -> DataFrame:
        folder, fs = self._fs(self.path)
        if not fs.exists(folder):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).option("pathGlobFilter", "*.json").json(self.path)

    def read(self, table: str, schema: T.StructType, run_ids: Iterable[str] | None = None) -> DataFrame:
        """Rows of a table's committed runs (all, or those named); an empty frame if there are none."""
        runs = self.runs().where(F.col("table") == table.rstrip("/"))
        if run_ids is not None:
            runs = runs.where(F.col("run_id").isin(list(run_ids)))
        folders = sorted(r.folder for r in runs.select("folder").collect())  # a row for each run
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", table.rstrip("/")).parquet(*folders).select(*schema.names)

    # ------------------------------------------------------------ writing
    def append(self, run_id: str, tables: Mapping[str, DataFrame], partition_by: Iterable[str] = (), replace: bool = False,
               replaces: Iterable[str] = ()) -> dict[str, int]:
        """Write the frames of one run and commit them together; rows by table.  Frames that are the same object are
        computed once.  A committed run id is left as it is unless ``replace``; empty frames add no folder."""
        if not replace and self.committed(run_id):
            return {t: 0 for t in tables}
        self._file(run_id)
        held: dict[int, DataFrame] = {}
        lines, counts = [], {}
        for table, frame in tables.items():
            rows = held.setdefault(id(frame), frame if len(tables) == 1 else cut_lineage(frame))
            folder = f"{table.rstrip('/')}/run={run_id}/attempt={uuid.uuid4().hex}"
            rows.write.partitionBy(*partition_by).parquet(folder)
            counts[table] = self.spark.read.schema(frame.schema).parquet(folder).count()  # from the files' footers
            if counts[table]:
                lines.append({"run_id": run_id, "table": table.rstrip("/"), "folder": folder, "n_rows": counts[table], "replaces": list(replaces)})
        self._commit(run_id, lines or [{"run_id": run_id, "table": None, "folder": None, "n_rows": 0, "replaces": list(replaces)}])
        return counts

    def _commit(self, run_id: str, lines: list[dict]) -> None:
        place, fs = self._fs(self._file(run_id))
        beside, _ = self._fs(f"{self.path.rstrip('/')}/_{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        try:
            out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines).encode()))
        finally:
            out.close()
        if fs.exists(place):
            fs.delete(place, False)
        if not fs.rename(beside, place):
            raise OSError(f"run {run_id} could not be committed")

    def compact(self, table: str, schema: T.StructType, run_id: str, partition_by: Iterable[str] = ()) -> int:
        """One run in place of all committed runs that wrote this table only; the rows stay the same."""
        runs = self.runs()
        shared = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("table").alias("table")).where((F.col("n") == 1) & (F.col("table") == table.rstrip("/")))
        old = [r.run_id for r in shared.select("run_id").collect()]
        if len(old) < 2:
            return 0
        return self.append(run_id, {table: self.read(table, schema, old)}, partition_by, replaces=old)[table]
