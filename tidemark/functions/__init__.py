"""Column-level semantics: predicates, scalar functions, aggregates, JSON."""
