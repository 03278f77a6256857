"""The library's registered queries: name to function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from loomspark.queries import sources, filters, joins, aggregates, ordering, batching, text, tokens, vectors, streams, plans  # noqa: F401
from loomspark.registry import ORACLES, QUERIES  # noqa: F401
