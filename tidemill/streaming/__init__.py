"""Micro-batch forms of the polled cycles."""
