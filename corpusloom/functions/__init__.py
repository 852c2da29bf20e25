"""Column functions: text cleaning, tokenising, keys, lexicon fields and statistics."""
