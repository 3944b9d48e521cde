"""Tensor file formats: the native container, importers, and the Spark data source."""
