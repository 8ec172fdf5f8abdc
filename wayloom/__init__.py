"""wayloom: a PySpark engine for origin-destination trajectory analytics."""
