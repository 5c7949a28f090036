"""Order-picking analytics on Spark: every operator works on all tenants and batches at once."""

from pickflow.session import build_session
from pickflow.sources.tables import Tables, load_tables

__all__ = ["Tables", "build_session", "load_tables"]
