"""End-to-end plans: source fusion, evaluation and repair recipes."""
