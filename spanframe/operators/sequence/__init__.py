"""Sequence operators: whole tables of sequences, cut into bounded chunks where order matters."""
