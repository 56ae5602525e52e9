"""Physical-plan properties: JVM-only, no cartesian joins, pruned scans,
filters pushed to parquet on real extracts."""

import datetime as dt

import pytest

import __spark_entry__ as E
from churnlab.config import WAREHOUSE_RULES
from churnlab.operators.flags import split_contacted
from churnlab.plans import catalog
from churnlab.plans import queries as Q
from churnlab.sources import DomainTables
from paths import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_or_nested_loop(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_scan_reads_only_needed_columns(spark):
    plan = E.queries()["q18_reversals_by_month"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_discount" not in plan


def test_churn_flag_is_an_existence_join(spark):
    plan = plan_of(E.queries()["q19_reversal_ticket_churn"](spark, SF_SMALL))
    assert "ExistenceJoin" in plan
    assert "Window" in plan


def _write_extracts(spark, root):
    """Tiny extracts with the warehouse's column names (and a string contract
    in one table, a bigint one in the others)."""
    d = dt.date(2021, 2, 1)
    frames = {
        "sales": (
            [(1, d, "Nueva", "RESIDENCIAL", "RETAIL", "Altas por venta", "VENTA")],
            "Contrato BIGINT, Formato_Fecha DATE, Tipo_Venta STRING, Tipo_Cliente STRING, "
            "Subcanal__Venta STRING, Tipo_Movimiento STRING, Motivo STRING",
        ),
        "tickets": (
            [
                (10, 1, d + dt.timedelta(days=5), d + dt.timedelta(days=9), "X",
                 "CONSULTAS DE FACTURACION O COBRO", "NOTAS DE CREDITO", "DETALLE DE MONTOS", "CERRADA"),
                (11, 1, d - dt.timedelta(days=3), None, "X", "REVERSION AUTOMATICA", "GENERAL",
                 "MONTO DE FACTURACION", "CERRADA"),
            ],
            "TIQUETE_ID BIGINT, CONTRATO BIGINT, FECHA_APERTURA DATE, FECHA_FINALIZACION DATE, CLASE STRING, "
            "MOTIVO STRING, AREA STRING, SUBAREA STRING, ESTADO STRING",
        ),
        "service_orders": (
            [("1", d + dt.timedelta(days=10), d + dt.timedelta(days=20), "DESINSTALACION", "FINALIZADA")],
            "NOMBRE_CONTRATO STRING, FECHA_APERTURA DATE, FECHA_FINALIZACION DATE, TIPO_ORDEN STRING, ESTADO STRING",
        ),
        "discounts": (
            [(10, 0.0, 0.0, dt.date(1900, 1, 1), d)],
            "Numero_Tiquete BIGINT, Monto_Descuento DOUBLE, Porcentaje_Descuento DOUBLE, "
            "Fecha_Fin_Regalia DATE, Fecha_Tiquete DATE",
        ),
        "retention_tickets": (
            [(1, 10, dt.datetime(2021, 2, 1, 23, 30), "RETENIDO", "OFERTA", "DESCUENTO")],
            "Contrato BIGINT, NO_DE_TIQUETE BIGINT, FECHA_FINALIZACION TIMESTAMP_NTZ, SOLUCION_FINAL STRING, "
            "AGRUPACION_SUBAREA STRING, ESTRATEGIA_APLICADA STRING",
        ),
    }
    paths = {}
    for name, (rows, schema) in frames.items():
        p = str(root / name)
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(p)
        paths[name] = p
    return paths


def test_real_extracts_run_with_warehouse_rules_and_push_filters(spark, tmp_path):
    t = DomainTables.from_extracts(spark, _write_extracts(spark, tmp_path))
    out = Q.q19_reversal_ticket_churn(t, WAREHOUSE_RULES.with_year(2021))
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, 0)]
    assert [tuple(r) for r in Q.q02_sale_to_ticket_churn(t, WAREHOUSE_RULES).collect()] == [(2, 1, 1, 0)]
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = plan_of(Q.q19_reversal_ticket_churn(t, WAREHOUSE_RULES.with_year(2021)))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    pushed = " ".join(line for line in plan.splitlines() if "PushedFilters" in line)
    # reversals and billing tickets share one scan: the reason filter is an IN
    assert "In(MOTIVO, [CONSULTAS DE FACTURACION O COBRO,REVERSION AUTOMATICA])" in pushed
    assert "Not(In(SUBAREA, [0 A 30 DIAS," in pushed
    assert "IsNotNull(CLASE)" in pushed
    assert "EqualTo(TIPO_ORDEN,DESINSTALACION)" in pushed
    assert "EqualTo(ESTADO,FINALIZADA)" in pushed


@pytest.mark.parametrize(
    "name", ["q19_reversal_ticket_churn", "q20a_reversal_no_call_churn", "q20d_reversal_call_comparison"]
)
def test_reversal_queries_scan_tickets_once(spark, name):
    # reversals and billing tickets come from one shared aggregate (exchange reuse)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = E.queries()[name](spark, SF_SMALL)
        df.collect()
        final = plan_of(df).split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert final.count("FileScan parquet [l_") == 1
    # the comparison marks its events in one pass and has no second branch to share with
    assert ("ReusedExchange" in final) == (name != "q20d_reversal_call_comparison")


def test_extract_loader_conforms_names_and_types(spark):
    from churnlab.sources.extracts import conform

    raw = spark.sql(
        "SELECT 7 AS nombre_contrato, TIMESTAMP_NTZ '2021-03-01 23:30:00' AS Fecha_Apertura, "
        "DATE '2021-03-02' AS fecha_finalizacion, 'DESINSTALACION' AS tipo_orden, 'FINALIZADA' AS estado, "
        "'x' AS extra"
    )
    out = conform(raw, "service_orders", key_type="string")
    assert out.columns == ["contract", "opened", "finished", "order_type", "status"]
    assert dict(out.dtypes) == {
        "contract": "string", "opened": "date", "finished": "date", "order_type": "string", "status": "string",
    }
    assert tuple(out.first()) == ("7", dt.date(2021, 3, 1), dt.date(2021, 3, 2), "DESINSTALACION", "FINALIZADA")
    with pytest.raises(ValueError):
        conform(raw.drop("estado"), "service_orders")


def test_materialized_anchors_cut_the_scans(spark, tmp_path):
    from churnlab.config import FIXTURE_RULES
    from churnlab.sources import DomainTables

    base = DomainTables.from_testdata(spark, SF_SMALL)
    t = DomainTables.from_testdata(spark, SF_SMALL)
    sc = spark.sparkContext
    # on a cluster this is the shared folder the cluster names; set one only
    # where none is set, as here in a local test
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(str(tmp_path))
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    paths = Q.materialize_anchors(t, FIXTURE_RULES, spark)
    assert all(p.startswith(folder.rstrip("/")) for p in paths.values())
    for fn in (Q.q02_sale_to_ticket_churn, Q.q06_repeat_ticket_3_segments_churn, Q.q14_retained_offer_churn_0_60,
               Q.q19_reversal_ticket_churn, Q.q20d_reversal_call_comparison, Q.q22_credit_note_resolution_churn):
        got = sorted(map(tuple, fn(t, FIXTURE_RULES).collect()), key=repr)
        assert got == sorted(map(tuple, fn(base, FIXTURE_RULES).collect()), key=repr)
    df = Q.q19_reversal_ticket_churn(t, FIXTURE_RULES)
    df.collect()
    plan = plan_of(df)
    assert "churnlab_anchors" in plan
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan


def test_command_line(spark, capsys, tmp_path):
    from churnlab.__main__ import main

    assert main(["--list"]) == 0
    assert "q19_reversal_ticket_churn" in capsys.readouterr().out
    assert main(["q18_reversals_by_month", "raw_monthly_distinct", "--data", SF_SMALL, "--master", "local[2]",
                 "--materialize", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "== q18_reversals_by_month" in out and "== raw_monthly_distinct" in out and "|month|total|" in out
    assert main(["q19_reversal_ticket_churn", "--data", SF_SMALL, "--master", "local[2]", "--explain"]) == 0
    assert "ExistenceJoin" in capsys.readouterr().out


def test_materialize_selected_sets_in_separate_runs(spark, tmp_path):
    from churnlab.config import FIXTURE_RULES
    from churnlab.sources import DomainTables

    t = DomainTables.from_testdata(spark, SF_SMALL)
    a = Q.materialize_anchors(t, FIXTURE_RULES, spark, folder=str(tmp_path), names=["uninstalls"])
    b = Q.materialize_anchors(t, FIXTURE_RULES, spark, folder=str(tmp_path), names=["uninstalls"])
    assert list(a) == ["uninstalls"] and a["uninstalls"] != b["uninstalls"]
    with pytest.raises(ValueError):
        Q.materialize_anchors(t, FIXTURE_RULES, spark, folder=str(tmp_path), names=["nope"])


def test_csv_extracts(spark, tmp_path):
    from churnlab.sources.extracts import load_extracts

    p = str(tmp_path / "orders_csv")
    spark.createDataFrame(
        [("7", "2021-03-01", "2021-03-05", "DESINSTALACION", "FINALIZADA")],
        "NOMBRE_CONTRATO STRING, FECHA_APERTURA STRING, FECHA_FINALIZACION STRING, TIPO_ORDEN STRING, ESTADO STRING",
    ).write.mode("overwrite").option("header", "true").csv(p)
    out = load_extracts(spark, {"service_orders": p}, format="csv", options={"header": "true"})["service_orders"]
    assert tuple(out.first()) == ("7", dt.date(2021, 3, 1), dt.date(2021, 3, 5), "DESINSTALACION", "FINALIZADA")


def test_split_contacted_deals_its_anchors(spark):
    """The joins' partitions aren't coalesced, whatever their size; null keys and repeated rows stay."""
    anchors = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 10), (None, 12)], "k int, day int")
    pairs = spark.createDataFrame([(2, 5), (2, 6), (None, 7), (3, 8)], "k int, day int")
    yes, no = split_contacted(anchors, pairs, "k")
    assert yes.columns == no.columns == anchors.columns
    assert sorted(map(tuple, yes.collect())) == [(2, 10), (2, 10)]
    assert sorted(map(tuple, no.collect()), key=str) == [(1, 10), (1, 11), (None, 12)]
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        found = [x.select("*").rdd.getNumPartitions() for x in split_contacted(anchors, pairs, "k")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
