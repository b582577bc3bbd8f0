"""Column functions: text, numbers and dates as row rules need them."""
