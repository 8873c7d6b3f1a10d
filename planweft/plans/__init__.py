"""Plan trees: nodes, expressions, JSON form, validation and explanation."""
