"""Jobs that run on their own: each has a command line, a config file and a function that takes a session."""
