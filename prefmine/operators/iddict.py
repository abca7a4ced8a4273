"""A dictionary of dense ids that grows by batches.

Ids are given in order of first appearance, as ``indexing.first_seen_index`` does for
one table; a batch's new keys (those the dictionary lacks, by an anti-join) get
the ids after the largest one so far, and an id once given never changes.  Each batch
is one committed version that appends its new keys; a batch applied again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.operators.indexing import positions_and_total
from prefmine.session import materialize, release
from prefmine.sources.versions import Versions


class KeyDictionary:
    def __init__(self, spark: SparkSession, base: str, key: str, name: str = "index"):
        self.versions, self.key, self.name = Versions(spark, base), key, name

    def append(self, batch: str, rows: DataFrame, order: Sequence[str]) -> bool:
        """Give ids to the keys of ``rows`` that have none, in the ``order`` of their first
        rows; False if ``batch`` was applied before.  Null keys get no id."""
        _, manifest = self.versions.latest()
        if batch in manifest.get("batches", []):
            return False
        first = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*order)).alias("first"))
        known = self.versions.read("ids", manifest)
        if known is not None:
            first = first.join(known.select(self.key), self.key, "left_anti")
        placed, n = positions_and_total(materialize(first, "new-keys"), ["first", self.key], self.name)
        start = manifest.get("next", 0)
        new = placed.select(self.key, (F.col(self.name) + F.lit(start)).alias(self.name))
        self.versions.commit(append={"ids": new}, next=start + n, batches=[*manifest.get("batches", []), batch])
        return True

    def ids(self) -> DataFrame:
        """(key, id) of every key so far."""
        return self.versions.read("ids")

    def encode(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the id of their key; rows whose key has none are dropped."""
        return rows.join(self.ids(), self.key)

    def compact(self) -> None:
        """Fold the batches' parts into one folder."""
        whole = materialize(self.ids(), "ids")
        self.versions.commit(replace={"ids": whole})
        self.versions.vacuum()
        release(whole)
