"""End-to-end plans: registered queries, oracle texts, training and inference."""
