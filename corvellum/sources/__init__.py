"""Reading and writing: tables, files, and the index of chunks."""
