"""Column expressions of the tensor data model."""
