"""Runnable jobs on the engine's operators: each module has a function that takes a session, and a command line."""
