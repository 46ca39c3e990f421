"""DataFrame operators: search, groups, scoring, metrics, text, ordinals, encoding."""
