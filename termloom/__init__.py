"""Index-term extraction, curation and rendering over document corpora, on Spark."""
