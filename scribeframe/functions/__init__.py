"""Column functions: text rules, edit distance, error rates, transcript formats, audio."""
