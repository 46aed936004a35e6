"""Chunked, compressed N-dimensional arrays as Spark DataFrames.

The planner modules under :mod:`ndgrid.plans` never import pyspark, so that selections, chunk grids and
read plans can be worked out and tested without a JVM.
"""

__version__ = "0.1.0"
