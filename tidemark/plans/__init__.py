"""Plan shapes shared by the operators: salted lookups, chunked windows, distributed order."""
