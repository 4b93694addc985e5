"""evalgate: segmentation-evaluation and experiment-governance operators on Spark DataFrames."""
