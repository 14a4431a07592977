"""Named queries: what the engine answers, and the SQL that checks it."""
