"""Quadrille: geometry, matching, fitting and raster analytics as Spark DataFrame operators."""
