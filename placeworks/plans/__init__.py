"""Registered queries over the bound tables, each with a reference statement in SQL."""

from placeworks.plans import baseline, catalogue, clauses, demand, linking, listing, pages, reviewing, scalars, texts, traffic, weekly
from placeworks.plans.registry import ORACLE_SQL, QUERIES

#: Names under which queries over all ids were registered while others read a subset of them, and the projection under that of the report.
for _name, _of in {"j10_any_name_in_query": "j10_name_in_query", "c21_any_article_relevance": "c21_article_relevance", "i05_any_open_at_ten": "i05_open_at_ten", "q28_projection": "i04_projection"}.items():
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[_of], ORACLE_SQL[_of]

__all__ = ["ORACLE_SQL", "QUERIES", "baseline", "catalogue", "clauses", "demand", "linking", "listing", "pages", "reviewing", "scalars", "texts", "traffic", "weekly"]
