"""docjson: JSON documents from free text, edited and queried at scale on Spark."""
