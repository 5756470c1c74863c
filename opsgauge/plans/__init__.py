"""Plans composed of several operators, and plan shapes they share."""
