"""DataFrame -> DataFrame operators. Docstring tags name the survey's operators."""
