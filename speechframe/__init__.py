"""Speech-corpus analytics on Spark: regions, chunk plans, transcripts, captions,
evaluation and job operations as DataFrame operators."""
