"""Training-data operators. Nothing outside this folder imports them, but for the guarded entry."""
