"""Readers and adapters that yield the long ``cells`` relation and other inputs."""
