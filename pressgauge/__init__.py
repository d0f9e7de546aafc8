"""News-coverage analytics and training-data operators, written as Spark jobs."""
