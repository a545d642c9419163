"""The data steps, each a function from DataFrame to DataFrame."""
