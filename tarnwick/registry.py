"""All registered queries of the engine and their SQL."""

from functools import wraps

from .plans import answer_queries, report_queries, request_queries, search_queries, text_queries
from .session import prepare


def _prepared(f):
    @wraps(f)
    def run(spark, sf_dir):
        return f(prepare(spark), sf_dir)

    return run


QUERIES = {name: _prepared(f) for name, f in {**text_queries.Q, **search_queries.Q, **report_queries.Q, **answer_queries.Q, **request_queries.Q}.items()}
ORACLE_SQL = {**text_queries.SQL, **search_queries.SQL, **report_queries.SQL, **answer_queries.SQL, **request_queries.SQL}
