"""The registered queries, each with the SQL that gives the same rows."""

from . import boosted, figures, forest, others, panels, policies, reports, sensitivity, stored  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
