"""Log messages as JSON lines, written by logging and read as a DataFrame."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at double, level string, source string, message string"


class JsonLines(logging.Handler):
    """Appends records to a file on the driver, one JSON object a line."""

    def __init__(self, path: str, level: int = logging.INFO):
        super().__init__(level)
        self.path = path

    def emit(self, record: logging.LogRecord) -> None:
        row = {"at": record.created, "level": record.levelname, "source": record.name, "message": record.getMessage()}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")


def read_logs(spark: SparkSession, path: str, level: str | None = None, since: float = 0.0, most: int = 1000) -> DataFrame:
    """The first `most` messages after `since`, in order; of one level if given."""
    rows = spark.read.schema(SCHEMA).json(path).where(F.col("at") > since)
    return (rows if level is None else rows.where(F.col("level") == level)).orderBy("at").limit(most)
