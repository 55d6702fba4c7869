"""Evidence-graph analytics on PySpark: claims, events, edges and graphs as DataFrame operations."""
