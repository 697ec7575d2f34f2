"""Part of chronoweave."""
