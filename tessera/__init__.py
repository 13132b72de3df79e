"""Tessera: versioned statement-graph analytics and table-cleaning operators on plain PySpark."""
