"""A PySpark engine for agent-trajectory analytics."""
