"""Tables that keep arriving."""
