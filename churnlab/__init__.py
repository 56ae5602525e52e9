"""churnlab: subscriber-lifecycle cohort analytics on Spark DataFrames.

    from churnlab import DomainTables, WAREHOUSE_RULES, Q
    t = DomainTables.from_extracts(spark, paths)
    Q.q19_reversal_ticket_churn(t, WAREHOUSE_RULES).show()
"""

from churnlab.config import FIXTURE_RULES, WAREHOUSE_RULES, DayWindow, Rules
from churnlab.plans import queries as Q
from churnlab.session import local_session, tune
from churnlab.sources import DomainTables

__version__ = "0.1.0"

__all__ = ["FIXTURE_RULES", "WAREHOUSE_RULES", "DayWindow", "DomainTables", "Q", "Rules", "local_session", "tune"]
