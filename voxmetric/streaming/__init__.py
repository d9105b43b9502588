"""The batch operators over growing input."""
