"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from webloom.plans import cases, more_cases, pages, project_cases, reference_cases

QUERIES: dict = {**pages.QUERIES, **cases.QUERIES, **more_cases.QUERIES, **project_cases.QUERIES, **reference_cases.QUERIES}
ORACLE_SQL: dict[str, str] = {**pages.ORACLE_SQL, **cases.ORACLE_SQL, **more_cases.ORACLE_SQL, **project_cases.ORACLE_SQL, **reference_cases.ORACLE_SQL}
FLAGSHIP = "page_links"
