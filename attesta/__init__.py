"""Research-data forensics as Spark plans."""
