"""Input tables that the registered queries derive from the given ones."""
