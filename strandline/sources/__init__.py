"""What operators read and write besides the store's tables."""
