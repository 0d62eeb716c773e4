"""Training-data operators: quality, deduplication, tokenising, PII, scoring, search, decontamination, toxicity.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
