"""Query modules: each offers QUERIES (name to callable) and SQL (name to oracle text)."""
