"""Pattern analytics over labelled property graphs, as Spark DataFrames."""
