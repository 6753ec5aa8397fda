"""The per-document parsing kernel: plain Python, no Spark, iterative, picklable."""
