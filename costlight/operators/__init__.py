"""DataFrame operators. All take keys: the same plan runs for one series or for many accounts."""
