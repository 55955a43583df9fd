"""Column functions: the text kernel every operator is built from."""
