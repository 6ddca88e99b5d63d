"""Column functions over the list columns that paths collect."""
