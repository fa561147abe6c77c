"""Queries over the driver's tables, each beside its SQL."""

from siltstone.plans import decision_queries as _decisions  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import media_queries as _media  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import more_queries as _more  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import parser_queries as _parsers  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import resolution_queries as _resolution  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import rule_queries as _rules  # noqa: F401  adds to queries.QUERIES
from siltstone.plans import stream_queries as _streams  # noqa: F401  adds to queries.QUERIES
