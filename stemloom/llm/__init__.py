"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; the driver entry module
adds its queries when it is present.
"""
