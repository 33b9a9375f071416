"""Reading, registering and storing documents and results."""
