"""Known source rows rendered as documents, words and model replies."""
