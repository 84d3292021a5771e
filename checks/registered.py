"""All registered queries; importing the groups fills the registry."""

from . import (  # noqa: F401
    group_delays, group_journeys, group_model, group_places, group_routes, group_scores, group_search, group_tables, group_text, group_timetable,
)
from .catalog import QUERIES, oracles  # noqa: F401
