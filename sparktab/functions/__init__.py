"""Column functions and distributed building blocks shared by the operators."""
