"""Readers of logs and projects, and writers of exports."""
