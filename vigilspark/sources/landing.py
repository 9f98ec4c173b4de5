"""Python data source over a landing zone of scraped posts (SC-13..15).

Connectors drop JSON lines into a folder; the source reads them in partitions of
one file each and applies what the connectors do: captions cut to 2000
characters, empty captions without an image dropped, and for message feeds only
texts with a keyword.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "post_id string, source string, username string, caption_text string, post_url string, image string, timestamp string"
CAPTION = 2_000


class LandingSource(DataSource):
    """``spark.read.format("landing").option("keywords", "a,b").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options)


class LandingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.keywords = [k.lower() for k in options.get("keywords", "").split(",") if k]
        self.least = int(options.get("minchars", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith((".json", ".jsonl"))]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                if not line.strip():
                    continue
                row = json.loads(line)
                text = (row.get("caption_text") or "")[:CAPTION]
                if not text and not row.get("image"):
                    continue
                if len(text) < self.least or (self.keywords and not any(k in text.lower() for k in self.keywords)):
                    continue
                yield tuple(text if c == "caption_text" else row.get(c) for c in ("post_id", "source", "username", "caption_text", "post_url", "image", "timestamp"))


def register(spark) -> None:
    spark.dataSource.register(LandingSource)
