"""The store facade and the registered queries."""
