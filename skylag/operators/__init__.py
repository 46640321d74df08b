"""DataFrame -> DataFrame operators; every one runs distributed on the executors."""
