"""Readers, writers and the views that shape raw tables into payment data."""
