"""Named tables that are made once for a given content: a changed input, setting or version makes a stage and what follows anew.

A stage's key is the SHA-256 over its name, version, settings and the keys of what it needs; a source's key is a digest of
its rows. A stage is written under its key, then marked; a run that finds the mark reads the table instead of making it.
So a run that was cut off goes on where it stopped, and presets that share their first stages share the tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(rows: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order; one pass, a row to the driver."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    names = [F.xxhash64(text), F.xxhash64(F.lit("again"), text)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(h.cast("decimal(20,0)")).cast("string").alias(f"h{k}") for k, h in enumerate(names)]).first()
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in sorted(rows.columns)]
    return hashlib.sha256(json.dumps([kinds, list(sums)]).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    """``make(*needs, **settings)`` gives the table; raise ``version`` when its code changes."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    version: int = 1


class Stages:
    """Runs stages under ``root`` (a folder that all executors share). ``made`` and ``read`` tell what each run did."""

    def __init__(self, spark: SparkSession, root: str, sources: dict[str, DataFrame], keys: dict[str, str] | None = None):
        """``keys`` of sources that have a version of their own; the others are digested."""
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = dict(sources)
        self.keys = {name: (keys or {}).get(name) or content_key(rows) for name, rows in sources.items()}
        self.made: list[str] = []
        self.read: list[str] = []

    def _done(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(f"{path}.done").count() == 1
        except AnalysisException:
            return False

    def run(self, *stages: Stage) -> dict[str, DataFrame]:
        """The tables of the stages, which stand in an order in which needs come first."""
        for s in stages:
            missing = [n for n in s.needs if n not in self.tables]
            if missing:
                raise ValueError(f"stage {s.name} needs {', '.join(missing)}, which no source or earlier stage gives")
            described = [s.name, s.version, s.settings, [self.keys[n] for n in s.needs]]
            key = hashlib.sha256(json.dumps(described, sort_keys=True).encode()).hexdigest()
            path = f"{self.root}/{s.name}-{key[:20]}"
            if self._done(path):
                self.read.append(s.name)
            else:
                s.make(*(self.tables[n] for n in s.needs), **s.settings).write.mode("overwrite").parquet(path)
                self.spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
                self.made.append(s.name)
            self.tables[s.name], self.keys[s.name] = self.spark.read.parquet(path), key
        return {s.name: self.tables[s.name] for s in stages}


def shared_root(spark: SparkSession, name: str) -> str:
    """A folder for stages: under the cluster's ``spark.checkpoint.dir``, or one of its own on a local master (tests)."""
    import tempfile

    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return f"{given.rstrip('/')}/{name}"
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix=f'{name}-')}"
