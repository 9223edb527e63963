"""The registered queries, each with the SQL text it is checked against."""
