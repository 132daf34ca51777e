"""recfeat: recommendation features, engagement analytics and corpus preparation as PySpark jobs."""
