"""All registered queries outside the corpus operators, with their SQL: each module adds its own."""

from cragspan.plans import coded, lines, places, points, surfaces, triangles
from cragspan.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "coded", "lines", "places", "points", "surfaces", "triangles"]
