"""The catalog: one JSON document in numbered versions. A version is written once, so that of two writers one starts over."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from tidemark.sources.files import Files

#: Old versions kept for readers that are still at work.
KEPT = 20


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(f"{self.root}/_catalog") if n.startswith("v") and n.endswith(".json"))

    def read(self) -> dict[str, Any]:
        found = self._versions()
        if not found:
            return {"version": 0, "series": {}, "rollups": {}, "jobs": {}, "runs": []}
        return json.loads(self.files.read(f"{self.root}/_catalog/v{found[-1]:012d}.json"))

    def change(self, edit: Callable[[dict[str, Any]], Any]) -> Any:
        """Apply edit to the latest version and write the next; tried again if another writer came first."""
        for attempt in range(50):
            doc = self.read()
            out = edit(doc)
            doc["version"] += 1
            if self.files.write_new(f"{self.root}/_catalog/v{doc['version']:012d}.json", json.dumps(doc)):
                for old in self._versions()[:-KEPT]:
                    self.files.delete(f"{self.root}/_catalog/v{old:012d}.json")
                return out
            time.sleep(0.01 * attempt)
        raise RuntimeError("the catalog is being changed too often")
