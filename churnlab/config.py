"""Business rules, day windows and labels.

Rules are data: every query takes a ``Rules`` value instead of literals, so the
same plan runs on the test fixtures (``FIXTURE_RULES``) or on the original
warehouse extracts (``WAREHOUSE_RULES``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DayWindow:
    """Whole-day window after an anchor date.

    ``DayWindow(0, 60)`` is (0, 60]: strictly after the anchor and at most 60
    days later.  ``DayWindow(180, 210, lo_inclusive=True)`` is [180, 210].
    A window never includes day 0: the later event must fall on a later date.
    ``hi=None`` leaves the window open-ended: any later date.
    """

    lo: int
    hi: int | None
    lo_inclusive: bool = False

    @property
    def min_days(self) -> int:
        return max(self.lo if self.lo_inclusive else self.lo + 1, 1)

    @property
    def max_days(self) -> int | None:
        return self.hi

    def __str__(self) -> str:
        hi = "inf)" if self.hi is None else f"{self.hi}]"
        return f"{'[' if self.lo_inclusive else '('}{self.lo},{hi}"


@dataclass(frozen=True)
class Rules:
    """Vocabulary that qualifies each kind of event."""

    year: int
    new_sale_type: str
    customer_types: tuple[str, ...]
    excluded_sub_channels: tuple[str, ...]
    movement_type: str
    sale_reasons: tuple[str, ...]
    aging_subareas: tuple[str, ...]
    void_status: str
    billing_reason: str
    reversal_reason: str
    credit_note_areas: tuple[str, ...]
    uninstall_type: str
    completed_status: str
    retained_outcome: str
    offer_group: str
    excluded_strategies: tuple[str, ...]
    open_ended_year: int = 1900

    def with_year(self, year: int) -> "Rules":
        return replace(self, year=year)


# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original scripts' vocabulary (warehouse
# rules) or the fixture derivation in FIXTURES.md (fixture rules); do not edit.
# ---------------------------------------------------------------------------

WAREHOUSE_RULES = Rules(
    year=2021,
    new_sale_type="Nueva",
    customer_types=("PROGRAMA HOGARES CONECTADOS", "RESIDENCIAL", "EMPLEADO"),
    excluded_sub_channels=("OUTBOUND PYMES", "INBOUND PYMES", "HOTELERO", "PYMES – NETCOM"),
    movement_type="Altas por venta",
    sale_reasons=("VENTA NUEVA", "VENTA"),
    aging_subareas=(
        "0 A 30 DIAS",
        "30 A 60 DIAS",
        "60 A 90 DIAS",
        "90 A 120 DIAS",
        "120 A 150 DIAS",
        "150 A 180 DIAS",
        "MAS DE 180",
    ),
    void_status="ANULADA",
    billing_reason="CONSULTAS DE FACTURACION O COBRO",
    reversal_reason="REVERSION AUTOMATICA",
    credit_note_areas=("NOTAS DE CREDITOS", "NOTAS DE CREDITO"),
    uninstall_type="DESINSTALACION",
    completed_status="FINALIZADA",
    retained_outcome="RETENIDO",
    offer_group="OFERTA",
    excluded_strategies=(
        "VISITA TECNICA",
        "NO SE LE APLICO ESTRATEGIA",
        "CAMBIO DE NOMBRE",
        "DISCULPAS POR EL INCONVENIENTE",
        "SALIDA DEL PAIS POR 3 MESES",
        "SALIDA DEL PAIS POR 6 MESES",
        "COORDINACION VISITA",
        "RECONEXION SIN COSTO",
        "ANULACION FACTURA",
        "SUSPENSION TEMPORAL",
        "COVID19 X 3 MESES",
    ),
    open_ended_year=1900,
)

# Sub-area values of the optional ticket filters (commented toggles).
WAREHOUSE_SUBAREAS = ("MONTO DE FACTURACION", "DETALLE DE MONTOS")

FIXTURE_RULES = Rules(
    year=1997,
    new_sale_type="new",
    customer_types=("HOUSEHOLD", "BUILDING", "FURNITURE"),
    excluded_sub_channels=("outbound_smb", "inbound_smb", "hospitality", "smb_partner"),
    movement_type="activation",
    sale_reasons=("new_sale", "sale"),
    aging_subareas=(
        "aging_0_30",
        "aging_30_60",
        "aging_60_90",
        "aging_90_120",
        "aging_120_150",
        "aging_150_180",
        "aging_over_180",
    ),
    void_status="void",
    billing_reason="billing_inquiry",
    reversal_reason="auto_reversal",
    credit_note_areas=("credit_notes", "credit_note"),
    uninstall_type="uninstall",
    completed_status="completed",
    retained_outcome="retained",
    offer_group="offer",
    excluded_strategies=(
        "excluded_0",
        "excluded_2",
        "excluded_4",
        "excluded_6",
        "excluded_8",
        "excluded_10",
    ),
    open_ended_year=1900,
)

FIXTURE_SUBAREAS = ("bill_amount", "bill_detail")

# Output labels (fixed).
CHURNED, KEPT = "churned", "kept"
REPEAT, NEW = "repeat", "new"
REPEAT_LE_2M, REPEAT_2M_4M = "repeat_le_2m", "repeat_2m_4m"
CALLED, NOT_CALLED = "called", "not_called"

# Windows used by the scripts.
W_0_60 = DayWindow(0, 60)
W_0_120 = DayWindow(0, 120)
W_90_120 = DayWindow(90, 120)
W_TENURE = DayWindow(180, 210, lo_inclusive=True)
W_AFTER = DayWindow(0, None)
RECURRENCE_2 = (60, 120)
RECURRENCE_3 = (60, 120, 180)
