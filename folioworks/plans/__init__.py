"""Whole jobs, views over test tables and the registered queries."""
