"""Rain-gauge streams that feed analyses; an extension beyond steady peak flow."""
