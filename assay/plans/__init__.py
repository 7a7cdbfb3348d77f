"""Configuration, the evaluation plan, and the queries over the test tables."""
