"""Statements as text: statement JSON, RDF syntaxes and XML records."""
