"""Part of the staffloom library."""
