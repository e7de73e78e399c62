"""User-level queries composed from the operators, each one lazy plan."""
