"""DataFrame operators: joins, counts, matching, de-duplication."""
