"""quern: an analytics engine expressed in PySpark's DataFrame, SQL and Structured Streaming APIs."""

from quern.session import get_session
from quern.sources.tables import TABLES, load, table_path

__all__ = ["TABLES", "get_session", "load", "table_path"]
