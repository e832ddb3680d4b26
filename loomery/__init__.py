"""Loomery: data integration and corpus preparation as lazy PySpark plans."""
