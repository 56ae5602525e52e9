"""Loading the original warehouse extracts (parquet) into the domain schema.

The scripts read five extracts by column name, case-insensitively.  This
module renames those columns to the neutral names the operators use,
normalises every contract key to one type (a bigint contract joined to a
string contract would otherwise be cast silently) and turns date columns into
``DATE`` (``DATE(ts)`` of a zoned timestamp is its UTC day).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FractionalType,
    IntegralType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from churnlab.functions.dates import to_day

# ---------------------------------------------------------------------------
# Extract column name -> domain column name, per table.
# ---------------------------------------------------------------------------
WAREHOUSE_COLUMNS: dict[str, dict[str, str]] = {
    "sales": {
        "Contrato": "contract",
        "Formato_Fecha": "sale_date",
        "Tipo_Venta": "sale_type",
        "Tipo_Cliente": "customer_type",
        "Subcanal__Venta": "sub_channel",
        "Tipo_Movimiento": "movement_type",
        "Motivo": "reason",
    },
    "tickets": {
        "TIQUETE_ID": "ticket_id",
        "CONTRATO": "contract",
        "FECHA_APERTURA": "opened",
        "FECHA_FINALIZACION": "closed",
        "CLASE": "class",
        "MOTIVO": "reason",
        "AREA": "area",
        "SUBAREA": "subarea",
        "ESTADO": "status",
    },
    "service_orders": {
        "NOMBRE_CONTRATO": "contract",
        "FECHA_APERTURA": "opened",
        "FECHA_FINALIZACION": "finished",
        "TIPO_ORDEN": "order_type",
        "ESTADO": "status",
    },
    "discounts": {
        "Numero_Tiquete": "ticket_id",
        "Monto_Descuento": "discount_amount",
        "Porcentaje_Descuento": "discount_pct",
        "Fecha_Fin_Regalia": "discount_end",
        "Fecha_Tiquete": "ticket_date",
    },
    "retention_tickets": {
        "Contrato": "contract",
        "NO_DE_TIQUETE": "ticket_id",
        "FECHA_FINALIZACION": "finished_ts",
        "SOLUCION_FINAL": "outcome",
        "AGRUPACION_SUBAREA": "subarea_group",
        "ESTRATEGIA_APLICADA": "strategy",
    },
}

# Domain columns that hold a calendar day.
DATE_COLUMNS = {
    "sales": ("sale_date",),
    "tickets": ("opened", "closed"),
    "service_orders": ("opened", "finished"),
    "discounts": ("discount_end", "ticket_date"),
    "retention_tickets": (),
}
KEY_COLUMNS = ("contract", "ticket_id")
NUMBER_COLUMNS = ("discount_amount", "discount_pct")
# Other names of an extract column.
COLUMN_ALIASES = {"discounts": {"fecha_tiquete": ("fechatiquete",)}}


def _declared(table: str, name: str) -> DataType:
    if name in DATE_COLUMNS[table]:
        return DateType()
    if name in NUMBER_COLUMNS:
        return DoubleType()
    return TimestampNTZType() if name == "finished_ts" else StringType()


# Domain schema of each extract, its keys as text.  What an extract's column may be stored as:
# days and timestamps as any of the date and timestamp types or as text, numbers as any number
# or text, keys as whole numbers (of any numeric type) or text, everything else as text only.
EXTRACT_SCHEMAS = {
    table: StructType([StructField(name, _declared(table, name)) for name in columns.values()]) for table, columns in WAREHOUSE_COLUMNS.items()
}
DAY_TYPES = (DateType, TimestampType, TimestampNTZType)


class SchemaDrift(ValueError):
    """An extract's columns aren't what the domain table declares."""


def drift(df: DataFrame, table: str, sources: Mapping[str, str]) -> list[str]:
    """What is wrong with the types of an extract; ``sources``: domain column -> column."""
    out = []
    for field in EXTRACT_SCHEMAS[table].fields:
        if field.name not in sources:
            continue
        found = df.schema[sources[field.name]].dataType
        allowed: tuple = (StringType,)
        if field.name in KEY_COLUMNS or isinstance(field.dataType, DoubleType):
            allowed = (NumericType, StringType)
        elif isinstance(field.dataType, DAY_TYPES):
            allowed = (*DAY_TYPES, StringType)
        if not isinstance(found, allowed):
            wanted = "whole number or string" if field.name in KEY_COLUMNS else field.dataType.simpleString()
            out.append(f"{sources[field.name]} ({field.name}) is {found.simpleString()}, not {wanted}")
    return out


def _parsed(col: Column, value: Column, what: str) -> Column:
    """``value`` made from text; text that isn't blank and gives none raises, by name."""
    blank = col.isNull() | (F.trim(col) == "")
    bad = F.raise_error(F.concat(F.lit(f"{what}: "), col))
    return F.when(blank, F.lit(None)).when(value.isNotNull(), value).otherwise(bad)


def day_column(col: Column, dtype: DataType, name: str, date_format: str | None) -> Column:
    """The calendar day of an extract's column; text is parsed strictly."""
    if not isinstance(dtype, StringType):
        return to_day(col, dtype)
    trimmed = F.trim(col)
    value = F.try_to_date(trimmed, date_format) if date_format else trimmed.try_cast("date")
    return _parsed(col, value, f"{name} is not a date{f' of format {date_format}' if date_format else ''}")


def key_text(col: Column, dtype: DataType, name: str) -> Column:
    """A key as text that is the same for every type an extract may store it in:
    whole numbers without point or exponent, text without outer blanks.  A key with a
    fraction raises, as it would silently join to nothing."""
    if isinstance(dtype, IntegralType):
        return col.cast("string")
    if isinstance(dtype, (FractionalType, DecimalType)):
        whole = col.cast("decimal(38,0)")
        bad = F.raise_error(F.concat(F.lit(f"{name}: key is not a whole number: "), col.cast("string"))).cast("string")
        return F.when(col.isNull(), F.lit(None).cast("string")).when(whole.cast(dtype) == col, whole.cast("string")).otherwise(bad)
    return F.trim(col.cast("string"))


def conform(
    df: DataFrame,
    table: str,
    columns: Mapping[str, Mapping[str, str]] = WAREHOUSE_COLUMNS,
    key_type: str = "string",
    date_format: str | None = None,
) -> DataFrame:
    """Rename, retype and project one extract to its domain schema.

    Missing columns and columns of a type that can't hold what is declared
    (:data:`EXTRACT_SCHEMAS`) raise :class:`SchemaDrift` with all their names before
    anything runs; text that is no date or no number raises with its column and value when
    it is read.  ``date_format`` is the pattern of days stored as text (ISO if not given).
    """
    mapping = {k.lower(): v for k, v in columns[table].items()}
    by_lower = {c.lower(): c for c in df.columns}
    for name, others in COLUMN_ALIASES.get(table, {}).items():
        for other in others:
            if name not in by_lower and other in by_lower:
                by_lower[name] = by_lower[other]
    missing = [k for k in mapping if k not in by_lower]
    wrong = [f"missing columns {missing}"] if missing else []
    wrong += drift(df, table, {name: by_lower[k] for k, name in mapping.items() if k in by_lower})
    if wrong:
        raise SchemaDrift(f"{table}: {'; '.join(wrong)}")
    out = []
    for src_lower, name in mapping.items():
        col = F.col(f"`{by_lower[src_lower]}`")
        dtype, what = df.schema[by_lower[src_lower]].dataType, f"{table}.{by_lower[src_lower]}"
        if name in DATE_COLUMNS[table]:
            col = day_column(col, dtype, what, date_format)
        elif name in KEY_COLUMNS:
            col = key_text(col, dtype, name).cast(key_type)
        elif name in NUMBER_COLUMNS:
            col = _parsed(col, F.trim(col).try_cast("double"), f"{what} is not a number") if isinstance(dtype, StringType) else col.cast("double")
        elif name == "finished_ts" and isinstance(dtype, StringType):
            col = _parsed(col, F.trim(col).try_cast("timestamp_ntz"), f"{what} is not a timestamp")
        elif name == "finished_ts" and isinstance(dtype, DateType):
            col = col.cast("timestamp_ntz")
        out.append(col.alias(name))
    return df.select(*out)


def load_extracts(
    spark: SparkSession,
    paths: Mapping[str, str],
    columns: Mapping[str, Mapping[str, str]] = WAREHOUSE_COLUMNS,
    key_type: str = "string",
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
    date_format: str | None = None,
) -> dict[str, DataFrame]:
    """Read each extract and conform it; ``paths`` maps domain table name
    (``sales``, ``tickets``, ...) to a path.  ``format`` / ``options`` go to
    ``spark.read`` (e.g. ``format="csv", options={"header": "true"}``; text
    dates are parsed by :func:`conform`)."""
    reader = spark.read.format(format).options(**(options or {}))
    return {t: conform(reader.load(p), t, columns, key_type, date_format) for t, p in paths.items()}
