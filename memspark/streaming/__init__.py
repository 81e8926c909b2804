"""streaming of memspark."""
