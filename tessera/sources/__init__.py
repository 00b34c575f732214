"""Tables, their schemas and how they are stored."""
