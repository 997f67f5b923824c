"""Tables kept by name in a folder, and PNG files as a sink. Both appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import palettes
from .images import png_parts

#: Names of the tables that a library keeps.
LIBRARY, CURRENT, PRESETS, SETTINGS = "palettes", "current", "presets", "settings"


def _entries(spark: SparkSession, folder: str, name: str) -> list[Row]:
    """The versions of a table that are complete, oldest first; none if nothing was kept."""
    try:
        rows = spark.read.schema("at timestamp, version string").parquet(f"{folder}/{name}/versions").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.at, r.version))


def _entries(spark: SparkSession, folder: str, name: str) -> list[Row]:
    """The versions of a table that are complete, oldest first; none if nothing was kept."""
    try:
        rows = spark.read.schema("at timestamp, version string").parquet(f"{folder}/{name}/versions").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: (r.at, r.version))


def keep(df: DataFrame, folder: str, name: str) -> None:
    """Writes a table under its name. A table may be made from the one that it replaces.

    It is written beside the versions that are there, and then listed; a write that fails leaves the last one in place.
    """
    spark, root, version = df.sparkSession, folder.rstrip("/"), uuid.uuid4().hex
    df.write.parquet(f"{root}/{name}/{version}")
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/{name}/versions")


def kept(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The last table that was kept under a name, None if none was. Other errors are the caller's."""
    root = folder.rstrip("/")
    known = _entries(spark, root, name)
    return spark.read.parquet(f"{root}/{name}/{known[-1].version}") if known else None


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where each was written, and what it is to be called."""

    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Files are written under names of their attempt and get their own when the whole job is done.

    All of them lie in a folder of the job, which the driver makes and removes at the end, so that attempts that failed
    leave nothing, and those that still run then can't write.
    """

    def __init__(self, path: str):
        self.path, self.job = path, f".pending-{uuid.uuid4().hex}"
        files, root = self._root()
        files.create_dir(f"{root}/{self.job}", recursive=True)

    def _root(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = self._root()
        pending, moves, out, current = f"{root}/{self.job}", [], None, None
        try:
            for row in rows:  # the parts of a file follow each other
                name = row.file.replace("/", "-")
                if name != current:
                    if out:
                        out.close()
                    moves.append((f"{pending}/{uuid.uuid4().hex}", f"{root}/{name}"))
                    out, current = files.open_output_stream(moves[-1][0]), name
                out.write(bytes(row.data))
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._root()
        for message in messages:
            for at, to in message.moves if message else ():
                files.move(at, to)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._root())

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


class Pictures(DataSource):
    """The sink 'pictures': rows of file (its name) and data as files of a folder that all executors share.

    Rows of one file are its parts and must follow each other in one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_pngs(pixels: DataFrame, names: DataFrame, path: str, rows: int = 64) -> None:
    """Each image of pixels as a PNG file, named by the source and palette in names(image_id, source, palette).

    Of images with one name the last image_id is written. A task holds one band of so many rows at a time.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(Pictures)
    named = names.select("image_id", palettes.file_name(names["source"], names["palette"], "png").alias("file"))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.col("image_id").desc()))
    named = named.withColumn("_k", last).where("_k = 1").drop("_k")
    parts = png_parts(pixels.join(named.select("image_id"), "image_id", "left_semi"), rows).join(named, "image_id")
    parts = parts.repartition("file").sortWithinPartitions("file", "part").select("file", "data")
    parts.write.format("pictures").mode("append").save(path)
