"""DataFrame to DataFrame operators over the catalogue."""
