"""Extracts by the qualified names that the warehouse gives them.

A name like ``project.dataset.2022-01-12_CR_ORDENES_SERVICIO_2021-01_A_2021-11_D`` is looked
up as a table of the session's catalog, then as a folder below a root, by ever shorter
parts of the name.  Which domain table an extract is follows from its own name.  Every
extract is read against declared types (:data:`churnlab.sources.extracts.EXTRACT_SCHEMAS`);
what has drifted is named.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from churnlab.sources.extracts import conform

# The part of an extract's name that says which table it is.
NAME_PARTS = {
    "sales": "ALTAS",
    "tickets": "TIQUETES_SERVICIO",
    "service_orders": "ORDENES_SERVICIO",
    "discounts": "DESCUENTOS",
    "retention_tickets": "DESCONEXIONES",
}


def parts_of(name: str) -> list[str]:
    """Project, dataset and table (fewer if not given); only the first two dots separate."""
    return [p for p in name.strip().strip("`").split(".", 2) if p]


def role_of(name: str) -> str:
    """The domain table that an extract of this name holds."""
    own = parts_of(name)[-1].upper()
    roles = [role for role, part in NAME_PARTS.items() if part in own]
    if len(roles) != 1:
        raise LookupError(f"{name}: which table is it? Its name holds {'none' if not roles else 'several'} of {sorted(NAME_PARTS.values())}")
    return roles[0]


class Warehouse:
    """Reads extracts by name.  ``root`` is a folder with one folder (or file) per extract, or
    with folders for projects and datasets; ``formats`` may name a format for single tables."""

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        format: str = "parquet",
        options: Mapping[str, str] | None = None,
        key_type: str = "string",
        date_format: str | None = None,
        formats: Mapping[str, str] | None = None,
    ):
        self.spark, self.root = spark, root.rstrip("/") if root else None
        self.format, self.options, self.formats = format, dict(options or {}), dict(formats or {})
        self.key_type, self.date_format = key_type, date_format

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def table(self, name: str, role: str | None = None) -> DataFrame:
        """The extract of that name as its columns are, not yet conformed."""
        parts = parts_of(name)
        tried = []
        for i in range(len(parts)):
            quoted = ".".join(f"`{p}`" for p in parts[i:])
            tried.append(f"table {quoted}")
            if len(parts) - i <= 2 and self.spark.catalog.tableExists(quoted):
                return self.spark.table(quoted)
        for i in range(len(parts) if self.root else 0):
            path = "/".join([self.root, *parts[i:]])
            tried.append(path)
            if self._exists(path):
                kind = self.formats.get(role or role_of(name), self.format)
                return self.spark.read.format(kind).options(**self.options).load(path)
        raise LookupError(f"{name}: not found as {', '.join(tried)}")

    def read(self, name: str, role: str | None = None) -> DataFrame:
        """The extract of that name in its domain schema."""
        role = role or role_of(name)
        return conform(self.table(name, role), role, key_type=self.key_type, date_format=self.date_format)

    def tables(self, names: Iterable[str] | Mapping[str, str]) -> dict[str, DataFrame]:
        """Domain table -> conformed extract, for names, or for a mapping from domain tables to names."""
        by_role = dict(names) if isinstance(names, Mapping) else {}
        for name in () if isinstance(names, Mapping) else names:
            role = role_of(name)
            if role in by_role:
                raise LookupError(f"both {by_role[role]} and {name} are {role}")
            by_role[role] = name
        return {role: self.read(name, role) for role, name in by_role.items()}
