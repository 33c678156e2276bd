"""corpusloom: document-corpus analytics and retrieval on PySpark DataFrames."""
