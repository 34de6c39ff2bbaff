"""netsift: attributed network graphs, evidence tables and their queries on Spark."""
