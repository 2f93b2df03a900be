"""Outing planning analytics as DataFrame-to-DataFrame operators."""
