"""Recorded provider payloads as a Spark data source: one JSON object a line."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordedQuotes(DataSource):
    """``spark.read.format("recorded_quotes").load(folder)``: (query_id, collected_at,
    payload) of every ``*.jsonl`` in a folder, a file a partition."""

    @classmethod
    def name(cls):
        return "recorded_quotes"

    def schema(self):
        return "query_id string, collected_at timestamp_ntz, payload string"

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in sorted(glob.glob(os.path.join(self.path, "*.jsonl")))]

    def read(self, partition):
        from datetime import datetime

        with open(partition.value) as f:
            for line in f:
                if line.strip():
                    x = json.loads(line)
                    yield x["query_id"], datetime.fromisoformat(x["collected_at"]), json.dumps(x["payload"])
