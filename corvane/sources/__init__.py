"""Readers and writers of logs, question sets and web pages."""
