"""Driver-side plan inputs: domain geometry and the views that the catalogue queries."""
