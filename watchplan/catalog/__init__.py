"""Named queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and the same in SQL where SQL can say it."""

from watchplan.catalog import aggregates, calibration, decisions, filters, investigation, joins, matching, ranking, scalars, sinks, streams, windows  # noqa: F401
from watchplan.catalog.registry import ORACLES, QUERIES  # noqa: F401
