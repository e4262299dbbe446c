"""Fit once, apply anywhere: plans hold small fitted state and transform tables by pure projections."""
