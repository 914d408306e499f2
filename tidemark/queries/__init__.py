"""The registered queries on the star-schema tables, each with the SQL that gives the same rows."""
