"""Column expressions and closed forms: vectors, identifiers, statistics."""
