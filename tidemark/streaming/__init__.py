"""Streaming folds of changelogs (an extension: the batch operators are the reference semantics)."""
