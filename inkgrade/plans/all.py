"""Imports every module that registers queries."""

from inkgrade.plans import relational, scores, reports, spatial, lines, masks  # noqa: F401
from inkgrade.plans import streams  # noqa: F401  uses SQL registered above
