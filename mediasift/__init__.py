"""mediasift: semantic media search and corpus preparation as Spark jobs."""
