"""Contract operators: profile, compare, row check, clean, validate, analyse."""
