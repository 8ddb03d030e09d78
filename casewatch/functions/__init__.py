"""Column expressions: Column in, Column out, no actions and no shuffles."""
