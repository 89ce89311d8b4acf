"""Picture files: a sink that writes one file per row, a batch at a time, and the encoder for it.

    df.select("name", "data").write.format("picture_files").mode("append").option("batch", "17").save(folder)

A task writes its files into a staging folder of its own. The commit puts the folders of the tasks that won in the batch's place, one
rename a task, after what an earlier try of the batch has left is gone; so a failed try, a lost executor or a repeated
batch leaves each picture once. Folders are any that Arrow's file systems open (file, hdfs, s3).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, Row, StructType

PNG = b"\x89PNG\r\n\x1a\n"


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit colour picture (height × width × red, green, blue) as a PNG file."""
    height, width = pixels.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    unfiltered = np.zeros((height, 1 + 3 * width), np.uint8)  # each line begins with its filter, none
    unfiltered[:, 1:] = pixels.reshape(height, -1)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(unfiltered.tobytes(), 6)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def encode(width: pd.Series, r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
    """Channel arrays in reading order to PNG files."""
    return pd.Series([png_bytes(np.stack([x, y, z], axis=-1).astype(np.uint8).reshape(-1, int(w), 3)) for w, x, y, z in zip(width, r, g, b)])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, base.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    count: int


class PictureWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch
        self.try_ = uuid.uuid4().hex

    def _staging(self) -> str:
        return f"_staging/{self.batch}-{self.try_}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = _opened(self.path)
        folder, count = f"{self._staging()}/{uuid.uuid4().hex}", 0
        for row in iterator:
            if not count:
                files.create_dir(f"{base}/{folder}", recursive=True)
            with files.open_output_stream(f"{base}/{folder}/{row['name']}") as out:
                out.write(bytes(row["data"]))
            count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _opened(self.path)
        place = f"{base}/batch={self.batch}"
        if files.get_file_info(place).type != fs.FileType.NotFound:
            files.delete_dir(place)
        files.create_dir(place, recursive=True)
        for k, message in enumerate(m for m in messages if m is not None and m.count):
            files.move(f"{base}/{message.folder}", f"{place}/task={k}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What no task has won with goes."""
        files, base = _opened(self.path)
        if files.get_file_info(f"{base}/{self._staging()}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self._staging()}")


class PictureFiles(DataSource):
    """Write only: `sources.images.read_images` reads."""

    @classmethod
    def name(cls) -> str:
        return "picture_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        if overwrite:
            raise ValueError("picture_files replaces a batch, not a folder: use mode append and the option batch")
        return PictureWriter(self.options["path"], self.options.get("batch", "0"))
