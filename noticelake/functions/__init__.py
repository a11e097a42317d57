"""Subpackage of noticelake."""
