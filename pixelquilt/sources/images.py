"""Image sizes by path."""

from __future__ import annotations

import json
import struct

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Bytes of a file that are read: a picture's size stands in its header.
HEADER_BYTES = 1 << 16
#: Files of one partition.
FILES_PER_PARTITION = 1024


def header_size(head: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG file from its first bytes; nothing is decoded."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            kind = head[at + 1]
            # Frame headers hold the size; tables and restart marks of the same range do not.
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


class ImageHeaders(DataSource):
    """``(path, width, height)`` of the pictures below some folders: partitions are ranges of files, and of each file only
    the header is read. Files that are no pictures are left out."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, width bigint, height bigint"

    def reader(self, schema) -> "HeaderReader":
        return HeaderReader(json.loads(self.options["paths"]))


class HeaderReader(DataSourceReader):
    def __init__(self, folders: list[str]):
        self.folders = folders

    def partitions(self) -> list[InputPartition]:
        found = []
        for folder in self.folders:
            store, root = fs.FileSystem.from_uri(folder)
            files = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
            found += [InputPartition((folder, files[i : i + FILES_PER_PARTITION])) for i in range(0, len(files), FILES_PER_PARTITION)]
        return found

    def read(self, partition: InputPartition):
        folder, files = partition.value
        store, _ = fs.FileSystem.from_uri(folder)
        for path in files:
            with store.open_input_file(path) as file:
                size = header_size(file.read(HEADER_BYTES))
            if size:
                yield path, int(size[0]), int(size[1])


def image_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, width, height)`` of the pictures below the paths; other files are left out."""
    spark.dataSource.register(ImageHeaders)
    return spark.read.format("image_headers").option("paths", json.dumps(list(paths))).load()


#: Paths that are looked up apart because many rows share them, at most, and the parts their rows are dealt into.
HOT_PATHS, PARTS = 64, 64


def shared_paths(samples: DataFrame, path: str, most: int = HOT_PATHS) -> list[str]:
    """The paths that more than a ``most``-th part of the rows name, by counts that are added up where the rows lie; there
    are fewer than ``most``."""
    counts = samples.filter(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("_n"))
    total = samples.count()
    return [r[0] for r in counts.filter(F.col("_n") * most > total).select(path).collect()]


def with_image_size(samples: DataFrame, sizes: DataFrame, path: str = "image_path", parts: int = PARTS) -> DataFrame:
    """Attach sizes by resolved path; rows without an image, or whose image has no size, keep nulls.

    Rows without a path do not take part in the join. Rows of a path that very many share are dealt into ``parts`` parts,
    and the size of that path is there once for each of them, so no task gets them all.
    """
    hot = shared_paths(samples, path)
    own = [f for f in sizes.columns if f != "path"]
    nothing = [F.lit(None).cast(sizes.schema[c].dataType).alias(c) for c in own]
    without = samples.filter(F.col(path).isNull()).select("*", *nothing)
    is_hot = F.col(path).isin(hot) if hot else F.lit(False)
    dealt = samples.filter(F.col(path).isNotNull()).withColumn("_part", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(F.lit(0).cast("bigint")))
    keyed = sizes.withColumnRenamed("path", path)
    copies = F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    joined = dealt.join(keyed.withColumn("_part", F.explode(copies)), [path, "_part"], "left")
    return joined.select(*samples.columns, *own).unionByName(without)
