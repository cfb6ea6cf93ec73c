"""Reading and writing of tables and artifacts."""
