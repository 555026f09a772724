"""Column helpers, guards, exact quantiles and metric expressions."""
