"""cairn: record resolution, registry analytics and text-corpus operators on Spark DataFrames."""
