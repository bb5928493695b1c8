"""The given tables in the roles of the jobs, the registered queries and their SQL."""
