"""edgelake: request-log analytics for a network of edge caches, on Spark DataFrames."""
