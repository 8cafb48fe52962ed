"""Broadcast values whose classes executors need not be able to import."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast of the pickled value; a task that reads ``value`` unpickles it once."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self._raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: list = []

    def __getstate__(self) -> dict:
        return {"_raw": self._raw, "_value": []}

    @property
    def value(self) -> Any:
        if not self._value:
            self._value.append(pickle.loads(self._raw.value))
        return self._value[0]

    def unpersist(self) -> None:
        self._raw.unpersist()


def share(spark: SparkSession, value: Any) -> Shared:
    """Send a value of known size to all executors."""
    return Shared(spark, value)
