"""Catalog attribute analytics as DataFrame transformations, and training-data operators in ``attriva.llm``."""
