"""Plan shapes shared by the operators, and end-to-end flows."""
