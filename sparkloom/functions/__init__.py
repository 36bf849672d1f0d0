"""Column functions: text features, numbers, rewards."""
