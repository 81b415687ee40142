"""Relational operators of the catalogue: extraction, paging, dedup, enrichment, sets, reports."""
