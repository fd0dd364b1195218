"""factloom: document, retrieval and structured-fact analytics on Apache Spark."""
