"""plans of convan."""
