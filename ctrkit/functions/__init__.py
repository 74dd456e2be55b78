"""Column-level helpers; every function returns a Column and stays inside codegen."""
