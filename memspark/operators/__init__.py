"""operators of memspark."""
