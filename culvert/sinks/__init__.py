"""Reports and files made from results."""
