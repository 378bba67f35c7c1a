"""Session analytics on Spark: archives of agent transcripts as DataFrames."""
