"""Column functions: text folding, similarity, splitting."""
