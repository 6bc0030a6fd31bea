"""The queries of the core's two data problems."""

from __future__ import annotations

from sparkmill.operators.snapshots import P2_SQL, p2_found
from sparkmill.operators.units_normalize import p7_found, p7_normalized

QUERIES = {"p2_found": p2_found, "p7_found": p7_found, "p7_normalized": p7_normalized}
SQL = {"p2_found": P2_SQL}
