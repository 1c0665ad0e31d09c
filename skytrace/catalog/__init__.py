"""All checked queries; importing the section modules fills the registry."""

from skytrace.catalog import aggregation, clusters, features, neighbourhoods, scans, shifts, statistics, text, tracks  # noqa: F401
from skytrace.catalog.base import QUERIES, SQL, World, with_ctes  # noqa: F401

ORACLE = {name: with_ctes(sql) for name, sql in SQL.items()}
