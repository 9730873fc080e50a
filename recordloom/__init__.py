"""recordloom: record linkage and corpus preparation as Spark DataFrame operators."""
