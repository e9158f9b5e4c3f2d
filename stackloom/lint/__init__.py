"""Rule engines: statements and call chains are parsed once to features; rules are predicates over these."""
