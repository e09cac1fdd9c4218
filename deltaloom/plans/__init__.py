"""Query catalogue: operators applied to tables, with the SQL that gives the same rows."""
