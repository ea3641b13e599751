"""functions of convan."""
