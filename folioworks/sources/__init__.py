"""Readers of landed inventories."""
