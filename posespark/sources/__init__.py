"""Readers, generators and exporters."""
