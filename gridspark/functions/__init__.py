"""Part of gridspark; see README.md."""
