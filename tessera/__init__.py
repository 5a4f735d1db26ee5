"""A PySpark analytics engine for keyed measurement data."""
