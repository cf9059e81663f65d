"""Stateful operators over streams of events, each with its batch form (SS*)."""
