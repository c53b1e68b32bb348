"""Where data comes from: lake tables, JDBC tables, change streams and generated rows."""
