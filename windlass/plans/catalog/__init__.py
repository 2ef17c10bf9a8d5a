"""All named queries. Importing this package registers them."""

from windlass.plans.catalog import (  # noqa: F401
    files, full_run, joins, pages, projections, ratings, results, rollups, windows,
)
from windlass.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
