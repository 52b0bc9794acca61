"""Evidence retrieval and evaluation over document corpora, as Spark jobs."""
