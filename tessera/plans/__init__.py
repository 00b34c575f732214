"""Operators composed into whole requests, and the engine that offers them."""
