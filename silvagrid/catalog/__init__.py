"""Named queries over the driver tables: every operator runs over whole tables."""

from silvagrid.catalog import gridded, scores, tabular

QUERIES = {**tabular.QUERIES, **gridded.QUERIES, **scores.QUERIES}

__all__ = ["QUERIES"]
