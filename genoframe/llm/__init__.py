"""Operators for training-text work and mass statistics; nothing else imports this folder."""
