"""DataFrame -> DataFrame operators, one module per report family."""
