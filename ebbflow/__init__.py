"""ebbflow: one definition of a signed dataflow, run as a batch job or as a stream on Spark."""
