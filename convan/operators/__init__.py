"""operators of convan."""
