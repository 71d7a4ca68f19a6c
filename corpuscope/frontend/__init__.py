"""The language front end: tokens, nodes and the rules over them."""
