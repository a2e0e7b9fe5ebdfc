"""Column builders: they take and return Columns and stay visible to Catalyst."""
