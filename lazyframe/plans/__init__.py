"""Samples and cached facts that travel beside a plan."""
