"""End-to-end jobs built from the operators, and the query registry."""
