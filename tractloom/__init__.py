"""Area indicators and member points as Spark DataFrame jobs."""

from tractloom.plans.area_table import AreaRules, AreaSources, build_area_indicators
from tractloom.plans.map_views import (
    choropleth,
    choropleth_legend,
    detail_table,
    detail_tables,
    legend_breaks,
    undescribed_columns,
    variable_menu,
)
from tractloom.plans.members import (
    UnresolvedAddresses,
    member_points,
    require_resolved,
    resolve_cascade,
    shape_members,
)

__all__ = [
    "AreaRules",
    "AreaSources",
    "UnresolvedAddresses",
    "build_area_indicators",
    "choropleth",
    "choropleth_legend",
    "detail_table",
    "detail_tables",
    "legend_breaks",
    "member_points",
    "require_resolved",
    "resolve_cascade",
    "shape_members",
    "undescribed_columns",
    "variable_menu",
]
