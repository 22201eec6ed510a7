"""Reading files and map layers, and refusing what is ambiguous."""
