"""plans of memspark."""
