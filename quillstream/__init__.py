"""quillstream: PySpark-native analytics over transcripts, questions, organisations and engagements."""
