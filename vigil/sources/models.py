"""Stored models with versions: parameters, metrics and the model's numbers together, written once, by any number of writers.

A version is claimed by creating ``<name>/<version>/claim`` only if it isn't there, which file systems do for one writer alone; whoever
loses tries the next number. What was written counts once ``done`` stands beside it, so a reader never meets half a model.
"""

from __future__ import annotations

import base64
import json
import os
import pickle

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ModelStore:
    """A folder of models on any file system of the session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _write(self, name: str, text: str, overwrite: bool = False) -> None:
        out = self._fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, name: str) -> str:
        f = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def _claim(self, name: str) -> bool:
        """Create a file that isn't there; whether this writer did. Hadoop's local file system looks before it creates, so there the system call does it."""
        if self._fs.getUri().getScheme() == "file":
            local = self._path(name).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._write(name, "")
        except Py4JJavaError:
            if not self._fs.exists(self._path(name)):
                raise
            return False
        return True

    def _claimed(self, name: str) -> list[int]:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def versions(self, name: str) -> list[int]:
        """Whole versions of a model, from the first."""
        return [v for v in self._claimed(name) if self._fs.exists(self._path(f"{self.folder}/{name}/{v}/done"))]

    def save(self, name: str, model, parameters: dict | None = None, metrics: dict | None = None) -> int:
        """Store a model that pickles; its version."""
        if not name or "/" in name:
            raise ValueError(f"bad name {name!r}")
        body = base64.b64encode(pickle.dumps(model)).decode()
        version = max(self._claimed(name), default=0) + 1
        while True:
            at = f"{self.folder}/{name}/{version}"
            if self._claim(f"{at}/claim"):
                break
            version += 1
        self._write(f"{at}/about.json", json.dumps({"name": name, "version": version, "parameters": parameters or {}, "metrics": metrics or {}}))
        self._write(f"{at}/model", body)
        self._write(f"{at}/done", "")
        return version

    def load(self, name: str, version: int | None = None) -> tuple[object, dict]:
        """A model and what stands about it; the last whole version by default. Only load what you trust: models are pickles."""
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise KeyError(f"{name} has no version {version or ''}".rstrip())
        at = f"{self.folder}/{name}/{version or known[-1]}"
        return pickle.loads(base64.b64decode(self._read(f"{at}/model"))), json.loads(self._read(f"{at}/about.json"))

    def table(self) -> DataFrame:
        """(name, version, parameters, metrics) of all whole versions."""
        schema = "name string, version int, parameters map<string, string>, metrics map<string, double>"
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))] if self._fs.exists(self._path(self.folder)) else []
        files = [f"{self.folder}/{n}/{v}/about.json" for n in names for v in self.versions(n)]
        return self.spark.read.schema(schema).json(files) if files else self.spark.createDataFrame([], schema)
