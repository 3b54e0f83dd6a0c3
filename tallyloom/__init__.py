"""tallyloom: analytics over learning-program tables and document corpora, on Spark."""
