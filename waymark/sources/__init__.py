"""Readers and writers of graphs, automata and edges."""
