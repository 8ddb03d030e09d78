"""The registered queries: inputs shaped from the given tables, and the SQL each is compared with."""
