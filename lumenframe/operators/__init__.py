"""Builders: each takes frames and a request, and returns a frame. Nothing runs until a result is asked for, but where a result's columns depend on values (pivot)."""
