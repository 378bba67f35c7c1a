"""Part of the session analytics library."""
