"""Query languages and the plans that they become."""
