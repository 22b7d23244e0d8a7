"""Column-role naming convention of the panel.

prefix = role, suffix = derivation.  Validated at panel construction and used
to pick design-matrix columns without touching data (P4).
"""

from __future__ import annotations

import re

OUTCOME = "media_"
TREATMENT = ("occ_", "size_")
CONTROL = ("weekday_", "holiday")
INSTRUMENT = ("weather_", "covid_", "pc_")
DUMMY = "region_"
KEYS = ("unit", "day")

LAG_RE = re.compile(r"^(.*)_lag(-?\d+)$")


def role(col: str) -> str | None:
    if col in KEYS:
        return "key"
    if col.startswith(OUTCOME):
        return "outcome"
    if col.startswith(TREATMENT):
        return "treatment"
    if col.startswith(CONTROL):
        return "control"
    if col.startswith(INSTRUMENT):
        return "instrument"
    if col.startswith(DUMMY):
        return "dummy"
    return None


def validate(columns) -> None:
    unknown = [c for c in columns if role(c) is None and c not in ("n_events", "notes", "area")]
    if unknown:
        raise ValueError(f"columns without a role prefix: {unknown}")


#: Column family -> which lags of it enter a design.
LAG_RULES = (
    (re.compile(r"media_|size_"), lambda lag: lag != 0),
    (re.compile(r"weekday_|region_|weather_|covid_"), lambda lag: lag == 0),
    (re.compile(r".*_ewm"), lambda lag: lag == -1),
)


def design_lag(column: str) -> bool:
    """Does a lagged column enter the design?  Every rule whose family
    matches must allow the column's lag (no lag suffix: no lag)."""
    name, lag = LAG_RE.fullmatch(column).groups() if LAG_RE.fullmatch(column) else (column, None)
    lag = None if lag is None else int(lag)
    return all(allows(lag) for family, allows in LAG_RULES if family.match(name))
