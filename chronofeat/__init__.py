"""chronofeat: point-in-time relational features and corpus operators on PySpark."""
