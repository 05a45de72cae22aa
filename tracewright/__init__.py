"""Process mining on event logs, written as Spark DataFrame jobs."""

from tracewright.mining import mine, report
from tracewright.session import get_spark
from tracewright.spec import LogSpec

__all__ = ["LogSpec", "get_spark", "mine", "report"]
