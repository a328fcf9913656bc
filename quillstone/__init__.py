"""Source-structure analytics as DataFrame operators."""
