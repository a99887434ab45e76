"""pagemill: document analytics over whole corpora on PySpark."""
