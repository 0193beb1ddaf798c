"""notelake: storing, searching and auditing agents' notes as Spark DataFrames."""
