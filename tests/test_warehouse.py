"""Extracts by qualified name, declared types, and drift that is named."""

import datetime as dt

import pytest

from churnlab.config import WAREHOUSE_RULES
from churnlab.plans import queries as Q
from churnlab.sources import DomainTables, SchemaDrift, Warehouse
from churnlab.sources.extracts import EXTRACT_SCHEMAS, conform, load_extracts
from churnlab.sources.warehouse import parts_of, role_of
from test_plans import _write_extracts

NAMES = {
    "sales": "acme-prod.lake_01.2022-01-20_CR_ALTAS_V3_2021-01_A_2021-12_T",
    "tickets": "acme-prod.lake_01.2022-01-12_CR_TIQUETES_SERVICIO_2021-01_A_2021-11_D",
    "service_orders": "acme-prod.lake_01.2022-01-12_CR_ORDENES_SERVICIO_2021-01_A_2021-11_D",
    "discounts": "acme-prod.lake_01.2022-02-02_DESCUENTOS_OVAL_ADJ_T",
    "retention_tickets": "`acme-prod.lake_01.2022-02-02_TIQUETES_GENERALES_DE_DESCONEXIONES_T`",
}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    return _write_extracts(spark, tmp_path_factory.mktemp("plain"))


def test_names_and_roles():
    assert {role_of(n): n for n in NAMES.values()} == NAMES
    assert parts_of("`a-b.c.2022.x`") == ["a-b", "c", "2022.x"]
    with pytest.raises(LookupError, match="none of"):
        role_of("a.b.PAGOS")
    with pytest.raises(LookupError, match="several of"):
        role_of("ALTAS_Y_DESCUENTOS")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_extracts_below_a_root_by_qualified_name(spark, written, tmp_path, depth):
    for role, name in NAMES.items():
        spark.read.parquet(written[role]).write.parquet("/".join([str(tmp_path), *parts_of(name)[-depth:]]))
    t = DomainTables.from_warehouse(spark, NAMES.values(), str(tmp_path))
    plain = DomainTables.from_extracts(spark, written)
    for fn in (Q.q02_sale_to_ticket_churn, Q.q19_reversal_ticket_churn, Q.q10_zero_pct_retained_churn):
        got = [tuple(r) for r in fn(t, WAREHOUSE_RULES).collect()]
        assert got == [tuple(r) for r in fn(plain, WAREHOUSE_RULES).collect()] and got
    for name, schema in EXTRACT_SCHEMAS.items():
        found = getattr(t, name).schema
        assert [f.name for f in found] == schema.names
        assert all(f.dataType == schema[f.name].dataType for f in found)


def test_tables_of_the_catalog_come_first(spark, written):
    spark.read.parquet(written["discounts"]).createOrReplaceTempView("2022_DESCUENTOS_T")
    try:
        got = Warehouse(spark, "/nowhere").read("acme.lake.2022_DESCUENTOS_T")
        assert got.count() == 1 and got.columns[0] == "ticket_id"
    finally:
        spark.catalog.dropTempView("2022_DESCUENTOS_T")


def test_what_is_not_found_or_named_twice_is_said(spark, tmp_path):
    with pytest.raises(LookupError, match="X_ALTAS.*not found as.*X_ALTAS"):
        Warehouse(spark, str(tmp_path)).read("p.d.X_ALTAS")
    with pytest.raises(LookupError, match="both .* are sales"):
        Warehouse(spark, str(tmp_path)).tables(["A_ALTAS", "B_ALTAS"])


def test_wrong_types_fail_by_name_before_anything_runs(spark):
    df = spark.sql("SELECT 1.5D AS NOMBRE_CONTRATO, true AS FECHA_APERTURA, 20210301 AS FECHA_FINALIZACION, 7 AS TIPO_ORDEN, 'x' AS ESTADO")
    with pytest.raises(SchemaDrift) as e:
        conform(df, "service_orders")
    said = str(e.value)
    assert said.startswith("service_orders: ")
    for part in ("FECHA_APERTURA (opened) is boolean, not date", "FECHA_FINALIZACION (finished) is int, not date", "TIPO_ORDEN (order_type) is int, not string"):
        assert part in said
    assert "NOMBRE_CONTRATO" not in said  # a number may be a key; its value is checked when read
    with pytest.raises(SchemaDrift, match="missing columns .*estado.*FECHA_APERTURA"):
        conform(df.drop("ESTADO"), "service_orders")
    with pytest.raises(Exception, match="key is not a whole number: 1.5"):
        conform(df.selectExpr("NOMBRE_CONTRATO", "current_date() AS FECHA_APERTURA", "current_date() AS FECHA_FINALIZACION", "'a' AS TIPO_ORDEN", "ESTADO"), "service_orders").collect()


def csv(spark, path, rows):
    names = "Numero_Tiquete STRING, Monto_Descuento STRING, Porcentaje_Descuento STRING, Fecha_Fin_Regalia STRING, Fecha_Tiquete STRING"
    spark.createDataFrame(rows, names).coalesce(1).write.option("header", "true").csv(path)
    return {"discounts": path}


def test_csv_extracts_are_typed(spark, tmp_path):
    good = [("10", "0.0", "5", "31/12/2021", "01/02/2021"), ("11", None, " 2.5 ", "", " 03/02/2021 ")]
    paths = csv(spark, str(tmp_path / "good"), good)
    kw = {"format": "csv", "options": {"header": "true"}}
    out = load_extracts(spark, paths, date_format="dd/MM/yyyy", **kw)["discounts"]
    assert out.schema == EXTRACT_SCHEMAS["discounts"] or [f.dataType for f in out.schema] == [f.dataType for f in EXTRACT_SCHEMAS["discounts"]]
    day = dt.date
    assert sorted(map(tuple, out.collect())) == [("10", 0.0, 5.0, day(2021, 12, 31), day(2021, 2, 1)), ("11", None, 2.5, None, day(2021, 2, 3))]


@pytest.mark.parametrize(
    "row, said",
    [
        (("10", "0.0", "5", "2021-13-45", "2021-02-01"), "discounts.Fecha_Fin_Regalia is not a date: 2021-13-45"),
        (("10", "0.0", "5", "2021-12-31", "01/02/2021"), "discounts.Fecha_Tiquete is not a date: 01/02/2021"),
        (("10", "12,5", "5", "2021-12-31", "2021-02-01"), "discounts.Monto_Descuento is not a number: 12,5"),
    ],
)
def test_csv_values_of_a_wrong_type_fail_by_name(spark, tmp_path, row, said):
    paths = csv(spark, str(tmp_path / "bad"), [row])
    out = load_extracts(spark, paths, format="csv", options={"header": "true"})["discounts"]
    with pytest.raises(Exception, match=said):
        out.collect()


def test_command_line_reads_by_name(spark, written, tmp_path, capsys):
    from churnlab.__main__ import main

    for role in ("tickets", "service_orders"):
        spark.read.parquet(written[role]).write.parquet("/".join([str(tmp_path), *parts_of(NAMES[role])]))
    tables = [x for role in ("tickets", "service_orders") for x in ("--table", NAMES[role])]
    assert main(["q19_reversal_ticket_churn", "--warehouse", str(tmp_path), *tables, "--master", "local[2]"]) == 0
    assert "|1    |1    |1      |0   |" in capsys.readouterr().out
