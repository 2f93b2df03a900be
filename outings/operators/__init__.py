"""Reusable relational operators: latest-per-key, mutation, numbering, nearest neighbours."""
