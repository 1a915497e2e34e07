"""All registered queries of the library with their DuckDB SQL."""

from .queries import documents, evaluation, functions, match, policy, risk_and_reads, signals, streams  # noqa: F401
from .queries.base import ORACLE_SQL, QUERIES  # noqa: F401
