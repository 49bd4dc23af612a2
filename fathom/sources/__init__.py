"""Reading and writing corpora and graphs."""
