"""All queries over the driver tables by name, each with its SQL."""

from gridspark.plans import q_features, q_full, q_more, q_raster, q_scalar, q_shapes, q_store, q_streams, q_terrain, q_vector

QUERIES: dict = {}
ORACLE: dict = {}
for part in (q_scalar, q_raster, q_vector, q_more, q_terrain, q_features, q_store, q_streams, q_shapes, q_full):
    QUERIES |= part.Q
    ORACLE |= part.S
FLAGSHIP = QUERIES["flagship_region_report"]
