"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from deskmill.plans import chat_queries, core_queries
from deskmill.plans import source_queries, stream_queries, text_queries  # noqa: F401  (they add to core_queries)

QUERIES = {**chat_queries.QUERIES, **core_queries.QUERIES}
ORACLES = {**chat_queries.ORACLES, **core_queries.ORACLES}
