"""The named queries over the driver's tables, each with the DuckDB SQL that it must equal where SQL can say it."""

WIDTH = 64  # elements of an embedding, hence columns of the grid
GRID = """g AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS r, CAST(i AS BIGINT) AS c, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS BIGINT) AS z
    FROM embeddings, (SELECT unnest(range(64)) AS i))"""
NODES = "s AS MATERIALIZED (SELECT r, c, r * 64 + c AS node, z FROM g)"
OFFSETS = "o(k, dr, dc) AS (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1))"
EDGES = """e AS MATERIALIZED (SELECT a.node AS src, b.node AS dst, o.k, o.dr, o.dc, a.z AS za, b.z AS zb
    FROM s a CROSS JOIN o JOIN s b ON b.r = a.r + o.dr AND b.c = a.c + o.dc)"""
