"""Column helpers: scalar expressions used by the operators."""
