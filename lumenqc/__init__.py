"""lumenqc: image-production quality control and training-data preparation as Spark jobs."""
