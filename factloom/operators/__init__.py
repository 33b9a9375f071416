"""Table operators: layout, extraction, entities, comparison, checks."""
