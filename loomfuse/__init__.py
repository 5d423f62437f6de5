"""loomfuse: entity profiles and corpus operators, declared on Spark DataFrames."""
