"""Versioned tables: whole versions beside each other, and a small file that names the one in force.

A version is written whole and then named by one rename, so readers see the
last version or the next, never half of one; a crash between the two leaves the
last in force, and the next writer replaces what was left. Old versions stay
until ``drop_old``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

POINTER = "_current"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int | None:
        """Number of the version in force, None before the first."""
        at = self._at(POINTER)
        store = at.getFileSystem(self._conf)
        if not store.exists(at):
            return None
        stream = store.open(at)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def location(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"no version in force at {self.path}")
        return self.spark.read.parquet(self.location(version))

    def point(self, version: int) -> None:
        """Put a written version in force by one rename."""
        aside, at = self._at(f"_aside-{uuid.uuid4().hex}"), self._at(POINTER)
        stream = aside.getFileSystem(self._conf).create(aside)
        stream.write(bytearray(str(version).encode()))
        stream.close()
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf).rename(aside, at, options)

    def publish(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version, or the given one again, and put it in force."""
        last = self.version()
        number = version if version is not None else 0 if last is None else last + 1
        if number == last:
            raise ValueError(f"version {number} is in force and isn't written over")
        df.write.mode("overwrite").parquet(self.location(number))
        self.point(number)
        return number

    def drop_old(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions before the one in force, which stays."""
        version = self.version()
        for number in range(0 if version is None else version - keep):
            at = self._at(f"v{number}")
            at.getFileSystem(self._conf).delete(at, True)


def ensure(table: VersionedTable, schema: str, fills: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The table, created empty if it isn't there, migrated if it only lacks columns that ``fills`` can make.

    A fill gets the frame with the column as NULL and returns it filled. Other
    differences in names or types raise, and leave the table as it is.
    """
    wanted = T.StructType.fromDDL(schema)
    if table.version() is None:
        table.publish(table.spark.createDataFrame([], wanted))
        return table.read()
    df = table.read()
    have, fills = {f.name: f.dataType for f in df.schema}, fills or {}
    missing = [f for f in wanted if f.name not in have]
    if not missing and [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in wanted]:
        return df
    lost = [f.name for f in missing if f.name not in fills]
    other = [c for c in have if c not in wanted.names] + [f.name for f in wanted if have.get(f.name, f.dataType) != f.dataType]
    if lost or other:
        raise ValueError(f"columns {list(have)} can't become {wanted.names}: {lost + other}")
    for f in missing:
        df = fills[f.name](df.withColumn(f.name, F.lit(None).cast(f.dataType)))
    table.publish(df.select(*wanted.names))
    return table.read()


def import_csv(table: VersionedTable, path: str, columns: str) -> DataFrame:
    """The first version of a table from CSV files with the given columns, all texts stripped."""
    table.publish(files.read_keyed(table.spark, path, columns))
    return table.read()


IMAGE_FILLS = {"image_name": files.with_image_names}
