"""The change log and the stream that keeps derived indexes in step."""
