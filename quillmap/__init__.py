"""quillmap: a Spark-first engine that places people of the past on a spatial atlas."""
