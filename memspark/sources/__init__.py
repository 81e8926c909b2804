"""sources of memspark."""
