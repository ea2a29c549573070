"""Rule packs: a schema, constraints on values and references, and the names that tie both to documents."""
