"""One query per operator on the stand-in views, each with its DuckDB twin where SQL can say it."""
