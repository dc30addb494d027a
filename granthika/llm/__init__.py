"""Preparation of training data; nothing outside this subpackage imports it."""
