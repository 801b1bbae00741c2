"""Column functions: clocks, rounding, conditions, option prices."""
