"""Plan building blocks that keep ordered work spread over the cluster."""
