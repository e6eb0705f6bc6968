"""loomwork: dataset curation and detector evaluation as PySpark DataFrame jobs."""
