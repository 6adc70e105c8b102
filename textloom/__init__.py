"""Text-forensics and corpus analytics as Spark DataFrame plans."""
