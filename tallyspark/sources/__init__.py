"""Readers of statements; all banks are registered here, by one call."""

from .banks import register_all

register_all()
