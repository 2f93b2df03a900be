"""User-level analytics composed from the operators."""
