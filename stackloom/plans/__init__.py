"""Parameters and record layouts shared by several operators."""
