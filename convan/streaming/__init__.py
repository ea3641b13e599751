"""streaming of convan."""
