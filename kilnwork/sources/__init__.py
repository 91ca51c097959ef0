"""Reading page dumps, and the stores of chunks and keyword indexes."""
