"""The models: events to blocks, sessions, clients, users and reports."""
