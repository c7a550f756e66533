"""Training-data operators: each module holds one operator; ``queries`` registers the thin queries over them."""
