"""Reading and writing tables: CSV, JSON, INSERT dumps, scripts, layouts."""
