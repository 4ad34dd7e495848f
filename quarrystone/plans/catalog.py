"""All queries of the library."""

from quarrystone.plans import change, classify, elements, files, folders, geostat, operations, raster, spatial, tiling  # noqa: F401
from quarrystone.plans.registry import QUERIES, SQL  # noqa: F401
