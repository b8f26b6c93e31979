"""Tables, files and their writers."""
