"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from cohortlab.plans import clinical, evaluation, files, imaging, quality

MODULES = (evaluation, clinical, imaging, quality, files)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
