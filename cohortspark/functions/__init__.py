"""Column builders and ordered-data helpers shared by every operator."""
