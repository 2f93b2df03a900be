"""The registered queries: stand-in tables, Spark plans and their SQL twins."""
