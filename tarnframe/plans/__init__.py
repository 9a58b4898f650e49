"""From SQL text to a bound, folded query: parsing, binding and constant folding."""
