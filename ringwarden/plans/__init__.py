"""Registered queries, each with the plain SQL it is checked against."""
