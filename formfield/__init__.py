"""Racing-form analytics over Spark DataFrames: pages in, ranked predictions out."""
