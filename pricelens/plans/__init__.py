"""Named queries: each pairs a Spark job over the input tables with the SQL
that computes the same table in an independent engine (the correctness oracle).

Importing this package registers every query module.
"""

from .registry import ORACLE, QUERIES, query  # noqa: F401
from . import (compare_queries, catalog_queries, extract_queries, text_queries,  # noqa: F401,E402
               rank_queries, reuse_queries, vision_queries, training_queries, stream_queries)
