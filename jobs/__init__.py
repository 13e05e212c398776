"""Runnable jobs: each a function of a session and its settings, with a command line and a small config file beside it."""
