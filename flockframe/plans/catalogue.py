"""All registered queries."""

from . import q_clean, q_compare, q_coverage, q_draws, q_model, q_sources, q_spatial, q_trends  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
