"""Tables, adapters and stream sources."""
