"""End-to-end plans composed of the operators."""
