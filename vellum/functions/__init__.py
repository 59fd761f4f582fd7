"""Part of vellum; see the modules."""
