"""Operators for preparing training text at scale; nothing else in corpusloom imports this subpackage."""
