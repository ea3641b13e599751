"""sources of convan."""
