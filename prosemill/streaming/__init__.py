"""The stateless operators on streams."""
