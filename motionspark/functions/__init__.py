"""Column expressions: quaternions, easing, text and geometry."""
