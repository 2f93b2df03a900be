"""Readers for tables and service payloads, and table writers."""
