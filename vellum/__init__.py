"""Document-corpus analytics on Spark: catalogue, operators, sources and plans."""

from vellum.session import get_spark, read_table

__all__ = ["get_spark", "read_table"]
