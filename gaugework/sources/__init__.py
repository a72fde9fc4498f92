"""Reading, decoding, writing and routing of samples and host records."""
