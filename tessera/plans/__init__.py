"""Plan building blocks shared by operators: staged tables and connected components."""
