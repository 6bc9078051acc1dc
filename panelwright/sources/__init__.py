"""Readers, writers and cleaning of raw inputs."""
