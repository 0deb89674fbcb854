"""The registered queries, each with SQL that must give the same rows."""
