"""Runnable jobs: each a function of a session and paths, with a command line and a small config file."""
