"""The engine's operators over the driver's tables: QUERIES by name, and ORACLES, DuckDB SQL for the same rows."""

from . import answers, documents, search, sets, whole

QUERIES = documents.QUERIES | search.QUERIES | answers.QUERIES | sets.QUERIES | whole.QUERIES
ORACLES = documents.ORACLES | search.ORACLES | answers.ORACLES | sets.ORACLES | whole.ORACLES
