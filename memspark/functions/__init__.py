"""functions of memspark."""
