"""Composite jobs (retrieve, mine, score, merge, evaluate, rounds) and the query catalog."""
