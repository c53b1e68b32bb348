"""The registered queries, their inputs, and the SQL each is checked against."""
