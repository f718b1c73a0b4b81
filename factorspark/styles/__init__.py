"""Style descriptors."""
