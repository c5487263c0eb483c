"""All registered queries of the raster, mesh, palette and job operators, with their DuckDB SQL."""

from orolith.plans import geo_queries, mesh_queries, palette_queries, raster_queries

MODULES = [raster_queries, palette_queries, mesh_queries, geo_queries]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
