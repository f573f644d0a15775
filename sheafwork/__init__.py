"""sheafwork: tabular question answering, data quality and retrieval as Spark DataFrame plans."""
