"""Committed versions of a group of tables.

A version is a folder ``<base>/v<number>`` that holds newly written parquet tables
and, as the last file, a manifest: for each table the folders it consists of (in
this and earlier versions) and whatever the writer wants to remember.  A reader
takes the highest version with a manifest, so an interrupted write is as if it had
never been, and a repeated one starts over.  One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.session import shuffles_freed

MANIFEST = "_manifest.json"


class Files:
    """The few file-system calls that tables need, through Hadoop's file system, so they work
    on whatever store the cluster uses."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def text(self, path: str) -> str | None:
        """A small file's text; None if it is not there."""
        p = self._path(path)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Write a small file under another name and rename it, so it is there whole or not at all."""
        part, whole = self._path(path + ".part"), self._path(path)
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(whole):
            self.fs.delete(whole, False)
        if not self.fs.rename(part, whole):
            raise OSError(f"could not rename {path}.part")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class Versions:
    """The committed versions below ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.files = spark, Files(spark, base)
        self.base = self.files.base

    def latest(self) -> tuple[int, dict]:
        """(number, manifest) of the newest committed version; (0, {}) if there is none."""
        numbers = sorted((int(n[1:]) for n in self.files.names(self.base) if re.fullmatch(r"v\d+", n)), reverse=True)
        for n in numbers:
            text = self.files.text(f"{self.base}/v{n}/{MANIFEST}")
            if text is not None:
                return n, json.loads(text)
        return 0, {}

    def read(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        """The rows of all folders of ``table``; None if it has none."""
        manifest = self.latest()[1] if manifest is None else manifest
        paths = manifest.get("tables", {}).get(table)
        return self.spark.read.parquet(*[f"{self.base}/{p}" for p in paths]) if paths else None

    def commit(self, append: dict[str, DataFrame | list[DataFrame]] | None = None, replace: dict[str, DataFrame | list[DataFrame]] | None = None, **remember) -> dict:
        """Write a new version: ``append`` adds a folder to a table, ``replace`` makes one
        folder the whole table; other tables stay as they are.  A list of frames is written one after the
        other into the table's folder, so only one of their queries has shuffle files.  ``remember`` joins the
        manifest's other entries.  Returns the new manifest."""
        n, old = self.latest()
        n += 1
        self.files.delete(f"{self.base}/v{n}")  # what an interrupted write left
        tables = dict(old.get("tables", {}))
        for kind, frames in (("append", append or {}), ("replace", replace or {})):
            for name, df in frames.items():
                for some in df if isinstance(df, list) else [df]:
                    with shuffles_freed(self.spark):
                        some.write.mode("append").option("compression", "zstd").parquet(f"{self.base}/v{n}/{name}")
                tables[name] = (tables.get(name, []) if kind == "append" else []) + [f"v{n}/{name}"]
        manifest = {**old, **remember, "tables": tables, "version": n}
        self.files.put(f"{self.base}/v{n}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
        return manifest

    def vacuum(self) -> None:
        """Delete the folders of older versions that the newest one does not use."""
        n, manifest = self.latest()
        used = {p for paths in manifest.get("tables", {}).values() for p in paths}
        for k in range(1, n):
            for name in self.files.names(f"{self.base}/v{k}"):
                if f"v{k}/{name}" not in used:
                    self.files.delete(f"{self.base}/v{k}/{name}")


def fingerprint(spark: SparkSession, paths: list[str], **params) -> str:
    """What identifies the inputs of a build: the files below ``paths`` with their sizes and
    times of change, and the parameters.  Spark lists the files (contents are not read)
    and one row comes back, however many there are; a path without files counts as such."""
    there = [p for p in paths if Files(spark, p).fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    rows = []
    for p in sorted(there):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p)
                 .select("path", "length", "modificationTime"))
        one = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string"),
                        F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
        rows.append([p, *one])
    gone = sorted(set(paths) - set(there))
    return json.dumps({"files": rows, "gone": gone, "params": params}, sort_keys=True, default=str)
