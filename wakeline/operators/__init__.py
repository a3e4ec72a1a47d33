"""DataFrame transforms of each layer; none of them collects rows in the data path."""
