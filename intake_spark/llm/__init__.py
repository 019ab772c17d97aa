"""Operators of a training-data pipeline, one module per operator, over tables of documents and pages."""
