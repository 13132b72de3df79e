"""Sources of raw statements: statement JSON, N-Triples, Turtle and relational tables."""
