"""Puts the repository's root on the path, from wherever the tests are started."""
