"""See the package README for the modules in here."""
