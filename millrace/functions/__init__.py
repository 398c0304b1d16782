"""Column functions: no shuffles, no actions."""
