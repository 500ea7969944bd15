"""cubeflow: chunked, multi-resolution, N-dimensional array analytics on Spark DataFrames."""
