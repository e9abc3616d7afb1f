"""testlattice: test-coverage analytics and corpus preparation as Spark DataFrame jobs."""
