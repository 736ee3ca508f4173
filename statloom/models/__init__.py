"""Learners with parameters: each ``fit`` takes a table of features and labels, each model adds predictions to one."""
