"""The stateless operators over a growing folder of files."""
