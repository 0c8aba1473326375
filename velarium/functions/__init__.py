"""Column builders: number formats, distances, lower bounds."""
