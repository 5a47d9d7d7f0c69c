"""metaweave: analytics over typed graphs, declared with the DataFrame API."""
