"""All registered queries of the sketch operators and the SQL that states them."""

from __future__ import annotations

from . import displaying, judging, labs, measuring, modelling, ordering, projecting, scanning, sketching  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
