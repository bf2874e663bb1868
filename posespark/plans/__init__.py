"""Views on the driver's tables, the queries over them, and the commands."""
