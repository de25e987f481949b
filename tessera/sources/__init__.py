"""Reading and writing tables and run artefacts."""
