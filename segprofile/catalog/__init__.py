"""Named queries over the test tables and the SQL that states the same result."""
