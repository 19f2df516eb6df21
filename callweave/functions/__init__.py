"""Column functions: text rules, nested shapes, labels and scores."""
