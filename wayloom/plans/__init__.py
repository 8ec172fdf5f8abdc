"""Named queries, their SQL, and helpers for iterative plans."""
