"""Column functions: keyed random draws, vector algebra, branching physics."""
