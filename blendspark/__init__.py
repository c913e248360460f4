"""Recipe analytics on PySpark: tables in, tables out."""
