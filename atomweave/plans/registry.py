"""All queries over the driver's tables, and the SQL that DuckDB runs for each."""

from __future__ import annotations

from atomweave.plans import crystal_queries, detail_queries, document_queries, lattice_queries, particle_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (particle_queries, document_queries, detail_queries, stream_queries, crystal_queries, lattice_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
