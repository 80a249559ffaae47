"""Reading and writing: review files, cached model answers, results."""
