"""Spark jobs that turn archives of chats, notes, pages and files into searchable knowledge."""
