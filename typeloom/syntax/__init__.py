"""A TypeScript parser and the text rewrites that rest on it."""
