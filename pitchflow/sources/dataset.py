"""A data set of images with label files and a description, written as one: all of it appears at once, or nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ROWS = "split string, image string, content binary, lines array<string>"
DESCRIPTION = "data.yaml"


@dataclass
class Written(WriterCommitMessage):
    """Images and label lines of each split that a task wrote."""

    images: dict[str, int]
    lines: dict[str, int]


class LabelledImagesWriter(DataSourceWriter):
    """Tasks write below a folder beside the target; the commit adds the description and renames it, an abort deletes it."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path if "://" in path else f"file://{path}", names, overwrite
        self.staging = f"{self.path.rstrip('/')}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.staging)
        done = Written({}, {})
        for row in iterator:
            if row.split not in done.images:
                for kind in ("images", "labels"):
                    store.create_dir(f"{root}/{row.split}/{kind}", recursive=True)
            lines = list(row.lines or [])
            with store.open_output_stream(f"{root}/{row.split}/images/{row.image}.png") as out:
                out.write(bytes(row.content))
            with store.open_output_stream(f"{root}/{row.split}/labels/{row.image}.txt") as out:
                out.write("".join(f"{x}\n" for x in lines).encode())
            done.images[row.split] = done.images.get(row.split, 0) + 1
            done.lines[row.split] = done.lines.get(row.split, 0) + len(lines)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.staging)
        _, target = fs.FileSystem.from_uri(self.path)
        splits = sorted({s for m in messages if m for s in m.images})
        if not splits:
            raise ValueError("no image to write")
        told = [f"{s}: {s}/images" for s in splits] + [f"nc: {len(self.names)}", f"names: {json.dumps(self.names)}"]
        told += [f"{s}_{what}: {sum(getattr(m, what).get(s, 0) for m in messages if m)}" for s in splits for what in ("images", "lines")]
        with store.open_output_stream(f"{root}/{DESCRIPTION}") as out:
            out.write("".join(f"{x}\n" for x in told).encode())
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                store.delete_dir(root)
                raise FileExistsError(self.path)
            store.delete_dir(target)
        store.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class LabelledImages(DataSource):
    """``df.write.format("labelled_images").option("names", "ball,player").mode("overwrite").save(path)`` of rows ROWS."""

    @classmethod
    def name(cls) -> str:
        return "labelled_images"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LabelledImagesWriter(self.options["path"], [x for x in self.options.get("names", "").split(",") if x], overwrite)


def write_dataset(rows: DataFrame, path: str, names: list[str]) -> None:
    """``rows`` (ROWS), one an image; an image without lines gets an empty label file. The same image of a split twice is written once."""
    spark = rows.sparkSession
    spark.dataSource.register(LabelledImages)
    rows.dropDuplicates(["split", "image"]).select("split", "image", "content", "lines").write.format("labelled_images").option("names", ",".join(names)).mode("overwrite").save(path)


def read_description(spark: SparkSession, path: str) -> DataFrame:
    """``key`` and ``value`` of each line of the description."""
    line = spark.read.text(f"{path}/{DESCRIPTION}")
    return line.selectExpr("substring_index(value, ':', 1) AS key", "trim(substr(value, instr(value, ':') + 1)) AS value")
