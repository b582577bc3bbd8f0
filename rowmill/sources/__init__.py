"""Sources: delimited text, workbooks, relational tables and JSON documents, each as a DataFrame with row numbers."""
