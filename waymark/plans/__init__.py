"""Planning: automata, constraints, and the expansion of path queries."""
