"""threadlens: title-mention analytics over comment threads, on the Spark DataFrame API."""
