"""Column functions: text parsing, units and arithmetic, ring geometry."""
