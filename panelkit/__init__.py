"""panelkit: panel-data analytics expressed as Spark DataFrame operations."""
