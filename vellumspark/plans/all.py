"""All queries of the core and their oracles."""

from . import pipeline, registry, sections, texts, values  # noqa: F401  (each adds its queries)

QUERIES, ORACLE = registry.QUERIES, registry.ORACLE
