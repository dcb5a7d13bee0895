"""mergelens: pull-request analytics and text-corpus processing on Spark."""
