"""Column functions: text and lexicon."""
