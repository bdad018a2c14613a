"""Operators of a training-data pipeline over documents, pages and benchmark items. Nothing else in the library uses them."""
