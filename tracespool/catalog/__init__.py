from tracespool.catalog import (  # noqa: F401
    detect_queries, edit_queries, filtering, job_queries, join_queries, model_queries, path_queries, run_queries, stat_queries,
    step_queries, tables, window_queries)
from tracespool.catalog.registry import QUERIES, SQL  # noqa: F401
