"""Questions in words: their kind, and the plan that answers them."""
