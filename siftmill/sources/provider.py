"""Storage providers as a Spark data source: a provider lists entries, Spark reads them in parallel.

``spark.dataSource.register(ProviderSource)``, then ``spark.read.format("siftmill_provider").option("provider", name)
.option("roots", json)``. Providers are registered by name in ``PROVIDERS``; a root that fails
before its first entry is skipped, one that fails later fails the read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Entry = tuple[str, int, datetime]


def local_entries(root: str) -> Iterator[Entry]:
    """Regular files below a local root, links followed; the root itself if it is a file."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    paths = [root] if os.path.isfile(root) else (os.path.join(d, n) for d, _, names in os.walk(root, followlinks=True) for n in names)
    for p in paths:
        try:
            s = os.stat(p)
        except OSError:
            continue
        if os.path.isfile(p):
            yield os.path.abspath(p), s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None)


PROVIDERS: dict[str, Callable[[str], Iterator[Entry]]] = {"local": local_entries}


class ProviderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siftmill_provider"

    def schema(self) -> str:
        return "provider string, path string, size bigint, modified_at timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return ProviderReader(self.options.get("provider", "local"), json.loads(self.options.get("roots", "[]")))


class ProviderReader(DataSourceReader):
    def __init__(self, provider: str, roots: list[str]):
        self.provider, self.roots = provider, roots

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.roots] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is None:
            return
        listed = 0
        try:
            for path, size, at in PROVIDERS[self.provider](partition.value):
                listed += 1
                yield self.provider, path, size, at
        except OSError:
            if listed:  # a listing cut off half-way would pass for a whole one
                raise
