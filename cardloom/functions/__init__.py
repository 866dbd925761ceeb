"""Column functions: grade scales, text cleaning, scores and geometry."""
