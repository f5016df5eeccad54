"""brindle: a Spark-first engine that finds leaked credentials and prepares text corpora."""
