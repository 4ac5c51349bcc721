"""Column helpers, fixed values and distribution tails."""
