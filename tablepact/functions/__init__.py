"""Column-level building blocks: predicates, coercions and text helpers."""
