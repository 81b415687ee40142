"""Whole jobs: pages to products, enrichment, and the run store."""
