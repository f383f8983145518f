"""quillspark: screening of time-stamped transcripts on Spark, as DataFrame -> DataFrame functions."""
