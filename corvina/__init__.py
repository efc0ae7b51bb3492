"""Corvina: cited retrieval and knowledge analytics as DataFrame plans."""
