"""Queries over the driver's tables, by subject; importing a module registers them."""
