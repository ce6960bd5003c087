"""All queries of the engine's own operators, and their SQL where SQL can express them."""

from .plans import model_queries, more_queries, sky_queries, stat_queries

FLAGSHIP = "P2_catalogue_fusion"


def _all():
    return {**sky_queries.QUERIES, **stat_queries.QUERIES, **model_queries.QUERIES, **more_queries.QUERIES}


def queries():
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}
