"""Import every module that registers queries."""

from suite import analysis_queries, basic_queries, clinical_queries, feature_queries  # noqa: F401
from suite.registry import QUERIES, SQL  # noqa: F401
