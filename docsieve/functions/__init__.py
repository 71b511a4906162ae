"""Column functions: text normalisation, fixed dimensions and the JSON reply kernel."""
