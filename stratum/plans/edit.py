"""An edit buffer over snapshots: marks and changes are collected first, then written as one new table version."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.filters import must_keep
from stratum.plans.repository import rewrite_snapshots


@dataclass
class EditBuffer:
    """Changes to some snapshots of a table; nothing happens before `result` is saved."""

    snapshots: DataFrame
    edits: dict[str, dict] = field(default_factory=dict)
    dropped: set[str] = field(default_factory=set)

    def modify(self, ids: Sequence[str], **changes) -> None:
        """add_tags, remove_tags, set_tags, or new values of fields; later changes add to earlier ones."""
        for i in ids:
            self.edits[i] = self.edits.get(i, {}) | changes

    def forget(self, ids: Sequence[str]) -> None:
        """Marks snapshots to be removed, or unmarks those that are."""
        self.dropped ^= set(ids)

    def status(self) -> DataFrame:
        """snapshots with modified and to_forget."""
        isin = lambda ids: F.col("id").isin(*ids) if ids else F.lit(False)
        return self.snapshots.withColumn("modified", isin(sorted(self.edits))).withColumn("to_forget", isin(sorted(self.dropped)))

    def result(self, now) -> tuple[DataFrame, DataFrame]:
        """(snapshots to save, ids to remove): modified ones replace their originals; what is protected is not forgotten."""
        saved = self.snapshots.limit(0)
        kinds: dict[str, tuple[dict, list[str]]] = {}
        for i, change in self.edits.items():
            if i not in self.dropped:
                kinds.setdefault(repr(sorted(change.items())), (change, []))[1].append(i)
        replaced = []
        for change, ids in kinds.values():
            own = self.snapshots.where(F.col("id").isin(*ids))
            new = rewrite_snapshots(own.withColumn("_old", F.col("id")), forget=True, **change)
            replaced.append(new.select(F.col("_old").alias("id")))
            saved = saved.unionByName(new.drop("_old"))
        gone = self.snapshots.where((F.col("id").isin(*sorted(self.dropped)) if self.dropped else F.lit(False)) & ~must_keep(F.lit(now).cast(self.snapshots.schema["time"].dataType))).select("id")
        for some in replaced:
            gone = gone.unionByName(some)
        return saved, gone
