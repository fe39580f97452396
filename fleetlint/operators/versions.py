"""Versions of a keyed table: a base, and per version the rows that changed.

A version adds a table of new rows and a table of the keys whose older rows no
longer count (tombstones). The base and earlier versions stay as they are; a
reader drops the rows whose keys a later version names. So a scan after a
repair writes the changed files only, and every version can still be read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.session import scratch_path


@dataclass
class VersionedTable:
    """``base`` is version 0; ``path`` holds the changes, one folder per version."""

    base: DataFrame
    keys: list[str]
    path: str
    latest: int = field(default=0)

    @classmethod
    def over(cls, base: DataFrame, keys: list[str], path: str | None = None) -> VersionedTable:
        return cls(base, keys, path or scratch_path(base.sparkSession, "versions"))

    def commit(self, rows: DataFrame, changed: DataFrame | None = None, version: int | None = None) -> int:
        """Add a version: ``rows`` replace all older rows of their keys and of those in ``changed`` (deleted
        where there is no row). Committing a version once more, after a failure, writes the same folders over."""
        number = self.latest + 1 if version is None else version
        rows.select(*self.base.columns).write.mode("overwrite").parquet(f"{self.path}/rows/version={number}")
        written = self._read("rows", number)
        keys = written.select(*self.keys)
        if changed is not None:
            keys = keys.unionByName(changed.select(*self.keys))
        keys.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/version={number}")
        self.latest = max(self.latest, number)
        return number

    def _read(self, kind: str, number: int) -> DataFrame:
        schema = self.base.schema if kind == "rows" else self.base.select(*self.keys).schema
        return self.base.sparkSession.read.schema(schema).parquet(f"{self.path}/{kind}/version={number}")

    def gone(self, version: int) -> DataFrame:
        """Keys whose older rows no longer count from a version on."""
        return self._read("gone", version)

    def rows(self, version: int) -> DataFrame:
        """What a version wrote."""
        return self.base if version == 0 else self._read("rows", version)

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table as of a version.

        Each part meets the keys of all later versions at once; those are few,
        so the join is planned by their size and the base is not shuffled for
        a small change.
        """
        last = self.latest if version is None else version
        out = None
        later: DataFrame | None = None
        for number in range(last, -1, -1):
            part = self.rows(number)
            if later is not None:
                part = part.join(later, self.keys, "left_anti").select(*self.base.columns)
            out = part if out is None else part.unionByName(out)
            if number:
                keys = self.gone(number)
                later = keys if later is None else later.unionByName(keys)
        return out

    def changes(self, version: int) -> DataFrame:
        """Keys of a version with ``change``: added, modified or removed against the version before."""
        old = self.read(version - 1).select(*self.keys, F.lit(True).alias("was")).join(
            self.gone(version), self.keys, "left_semi")
        new = self.rows(version).select(*self.keys, F.lit(True).alias("is"))
        change = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("modified")
        return new.join(old, self.keys, "full_outer").select(*self.keys, change.alias("change"))
