"""The queries that the driver runs, each with the SQL that gives the same rows."""
