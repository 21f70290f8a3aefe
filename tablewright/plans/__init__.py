"""Registered queries: derived input tables, the query per operator and its check in plain SQL."""
