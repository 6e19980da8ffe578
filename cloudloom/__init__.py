"""Point clouds and Gaussian splats as Spark DataFrames: codecs, transforms, sampling and quality metrics."""
