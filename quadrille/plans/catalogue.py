"""All queries of the geometry library; importing the modules below registers them."""

from quadrille.plans import adjust_queries, fit_queries, line_queries, raster_queries, source_queries, spatial_queries, tile_queries, warp_queries
from quadrille.plans.registry import ORACLES, QUERIES

FLAGSHIP = "residual_report"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "adjust_queries", "fit_queries", "line_queries", "raster_queries", "source_queries", "spatial_queries", "tile_queries", "warp_queries"]
