"""Text similarity search and corpus preparation on Spark DataFrames."""
